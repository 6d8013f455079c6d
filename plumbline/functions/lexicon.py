"""Fixed values of the default (Turkish) language pack: word lists, markers and replacements, in matching normal form.

Every operator takes its list as a parameter with these defaults, so that callers can supply another language.
"""

# fixed values
STOP_WORDS = "acaba ama bir bu bunu da de gibi icin ile mi mu nasil ne nedir olan olarak soru su ve veya ya belge belgede belgenin dokuman dokumanda ben bana beni benim sen sana seni senin la lan get git hadi".split()
GENERIC_ANSWER_TERMS = "belgeye gore kaynak kaynakta kaynaklara cevap bilgi bilgiler ilgili olarak sekilde".split()
NON_ENTITY_TERMS = "alir alan hangi indirim indirimi indirimli kadar kac nedir oran orani ogrenci ogrenciler yerlesen uygulanir uygulanan verilir yuzde".split()
CRITIQUE_MARKERS = ("ne dusunuyorsun", "sence", "degerlendir", "degerlendirme", "negatif", "olumsuz", "zayif", "eksik", "gelistir", "iyilestir", "guclu yon", "risk")
SUMMARY_MARKERS = (
    "ana konusu", "ana konu", "belgenin konusu", "dokumanin konusu", "dokuman konusu", "bu belge nedir", "bu dokuman nedir", "bu nasil bir belge", "nasil bir belge", "bu nasil bir dokuman", "nasil bir dokuman",
    "belgenin icerigi ne", "belge icerigi ne", "dokumanin icerigi ne", "dokuman icerigi ne", "bu belgede neler var", "belgede neler var", "bu dokumanda neler var", "dokumanda neler var", "bu belgede ne anlatiliyor",
    "bu belge ne anlatiyor", "belgede ne anlatiliyor", "belge ne anlatiyor", "bu belgede neler yer aliyor", "belgede neler yer aliyor", "bu dokumanda neler yer aliyor", "dokumanda neler yer aliyor",
    "hangi bilgiler var", "hangi bilgiler yer aliyor", "ne iceriyor", "neler iceriyor", "icerisinde neler var", "icinde neler var", "belgenin amaci", "dokumanin amaci", "amac ne", "amaci ne", "ne ise yarar", "neye yarar",
    "bu belge ne ise yarar", "bu dokuman ne ise yarar", "belgeyi ozetle", "bu belgeyi ozetle", "kisa ozet", "genel ozet", "ne hakkinda", "konusu nedir", "genel konusu",
)
SUMMARY_ALIASES = ("ozet", "konu", "ana konu", "amac", "kapsam", "icerik", "ne anlatiliyor", "ne hakkinda")
TYPOS = (
    ("bulegede", "belgede"), ("bulgede", "belgede"), ("belgee", "belge"), ("belgdee", "belgede"), ("dokumanda", "dokumanda"), ("pdfde", "pdfde"), ("egitmler", "egitmenler"), ("egitimler", "egitmenler"),
    ("egitmnler", "egitmenler"), ("egitmenlr", "egitmenler"), ("egitmn", "egitmen"), ("egitmen kimdr", "egitmen kimdir"), ("kimdr", "kimdir"), ("kmdir", "kimdir"), ("anlatiliyo", "anlatiliyor"),
    ("anlatiliyr", "anlatiliyor"), ("anlatilyor", "anlatiliyor"), ("hazirliyan", "hazirlayan"), ("hazirlayanlar", "hazirlayanlar"), ("sorumlusu kimdr", "sorumlusu kimdir"), ("nerde", "nerede"),
    ("nerden", "nereden"), ("tarihi ne", "tarih nedir"), ("onemlimi", "onemli mi"),
)
#: (triggers, aliases) of each group
ALIAS_GROUPS = (
    (("ozet", "konu", "hakkinda", "ne anlatiliyor", "ne anlatiyor", "icerik", "icerigi", "neler var", "neler yer aliyor", "nedir"), ("ozet", "konu", "ana konu", "icerik", "amac", "kapsam", "ne anlatiliyor", "ne hakkinda", "belge", "dokuman")),
    (("yazar", "yazarlar", "sahip", "sahibi", "hazirlayan", "hazirlayanlar", "sorumlu", "sorumlusu", "egitmen", "egitmenler", "egitimci", "egitimciler", "egitimi veren", "ders sorumlusu", "hoca", "hocasi", "veren kim", "kim verdi"), ("egitmen", "egitmenler", "egitimci", "egitimciler", "hazirlayan", "hazirlayanlar", "yazar", "yazarlar", "sorumlu", "sorumlusu", "ders sorumlusu", "hoca", "gorevli", "kisi", "kisiler")),
    (("tarih", "tarihi", "ne zaman", "baslangic", "baslama", "bitis", "sure", "kac gun", "hangi gun", "hangi tarihte"), ("tarih", "baslangic tarihi", "bitis tarihi", "sure", "zaman", "gun", "ay", "yil", "donem")),
    (("nerede", "nereden", "nereye", "neresi", "hangi sehir", "sehir", "il", "adres", "konum", "lokasyon", "yer"), ("yer", "konum", "adres", "sehir", "il", "lokasyon", "nerede", "nereden", "nereye")),
    (("amac", "amaci", "hedef", "hedefi", "neden", "ne icin", "kapsam", "kapsami", "ne ise yarar"), ("amac", "hedef", "kapsam", "gerekce", "ne icin", "ne ise yarar", "fayda")),
    (("katilimci", "katilimcilar", "kimler katilabilir", "hedef kitle", "ogrenci", "ogrenciler", "kursiyer", "kursiyerler", "kime yonelik"), ("katilimci", "katilimcilar", "hedef kitle", "ogrenci", "ogrenciler", "kursiyer", "kursiyerler", "kime yonelik")),
    (("ucret", "fiyat", "bedel", "maliyet", "tutar", "odeme", "kac tl", "kac lira", "para"), ("ucret", "fiyat", "bedel", "maliyet", "tutar", "odeme", "tl", "lira", "para")),
    (("gano", "not ortalamasi", "genel not ortalamasi", "ortalama", "universiteye giris sirasi"), ("gano", "not ortalamasi", "genel not ortalamasi", "universiteye giris sirasi", "basvuru kriterleri", "teknik uzmanlik sinavi", "teknik mulakat", "basari puani")),
)
NO_ANSWER_MARKERS = ("belgede yer almiyor", "belge iceriginde yer almiyor", "bu bilgi belgede yok", "bu bilgi belgede yer almiyor", "yuklenen belgede acikca yer almiyor")
EVALUATION_NO_ANSWER_MARKERS = ("belgede acikca yer almiyor", "belgede yer almiyor", "belge icinde bulunamadi", "belge icinde soruyla iliskili bir bolum bulunamadi")
NEGATIVE_MARKERS = (" degil", " yok", "bulunmuyor", "bulunmaz", "haric", "kapsamaz", "odenmez", "odemez", "uygulanmaz", "alamaz", "verilmez", "gerekmiyor", "gerekmez", "zorunlu degil", "mumkun degil")
RELATIONS = {
    "discount": ("indirim", "indirimli"), "scholarship": ("burs", "burslu"), "fee": ("ucret", "odeme", "bedel"), "duration": ("sure", "gun", "ay", "yil"), "requirement": ("sart", "kosul", "kriter", "gerekiyor"),
    "date": ("tarih", "donem", "ne zaman"), "coverage": ("kapsar", "kapsamaz", "kapsam"), "approval": ("onay", "karar", "belirlenir", "belirler"), "eligibility": ("basvur", "yararlan", "hak kazan"),
    "payment": ("oder", "odenir", "odenmez", "odeme"), "permission": ("izin", "yasak", "mumkun"),
}
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
SECTION_WORDS = ("amac", "kapsam", "dayanak", "tanimlar", "giris", "sonuc", "egitmenler", "egitimciler", "program icerigi", "icerik", "basvuru kosullari", "katilim sartlari", "degerlendirme", "genel hukumler", "yururluk", "yurutme")
BLOCK_HEADINGS = ("abstract", "summary", "ozet", "giris", "sonuc", "conclusion", "experience", "education", "skills", "projects", "certifications", "deneyim", "egitim", "beceriler", "projeler", "sertifikalar", "ders kodu ders adi", "harf notu akts")
NOISE_PHRASES = ("ne bileyim", "bilmiyorum", "bosver", "rastgele", "sacma", "laf olsun")
SLANG = ("la", "lan", "lo", "ya")
QUESTION_SHAPES = (" nedir", " ne ", " nasil", " hangi", " kac", " kim", " nerede", " nereden", " nerden", " nereye", " neresi", " neden", " mi", " mu", " mii", "?")
ANCHORS = ("belgede", "belgedeki", "belgenin", "bu belge", "dokumanda", "dokumandaki", "dokumanin", "bu dokuman", "bilette", "biletin", "bu bilet")
DEFINITION_MARKERS = ("nasil bir sey", "nasil bisey", "nasil birsey", "ne demek", "nedir anlat")
PROCEDURE_MARKERS = ("nasil cikilir", "nasil gidilir", "nasil yapilir", "nasil olunur", "nasil alinir", "nasil kullanilir")
EXTERNAL_TOPICS = ("uzay", "uzaya", "mars", "roket", "astronot", "araba", "telefon", "yemek", "spor", "bitcoin", "borsa", "film", "oyun", "olum", "hayat", "insanlik", "dunya", "tanri", "ask")
ABSTRACT_TERMS = ("olum", "hayat", "yasam", "insanlik", "insanligin", "dunya", "dunyadaki", "evren", "tanri", "kader", "ruh", "ask", "mutluluk", "varolus")
ABSTRACT_MARKERS = ("gercek mi", "gercekmi", "gecrekmi", "nedir", "ne demek", "amaci nedir", "amaci ne", "neden var")
LATEST_COURSE_MARKERS = ("aldigi son", "en son aldigi", "son aldigi", "son ders", "en son ders")
TITLE_MARKERS = ("anket", "form", "rapor", "sozlesme", "şartname", "sartname", "kilavuz", "kılavuz", "yonerge", "yönerge", "prosedur", "prosedür", "politika", "talimat", "elektronik bilet", "electronic ticket", "passenger itinerary", "seyahat belgesi")
INSTITUTION_MARKERS = ("universitesi", "fakultesi", "bolumu")
METADATA_LABELS = ("ogrenci bilgileri", "icerindekiler", "duzenlendigi tarih issue date", "duzenleyen issuance", "seri no serial no", "yolcu ismi passenger name", "bilet no ticket number", "rezervasyon no booking ref", "adres address", "firma ismi company name", "vergi dairesi hesap no", "tc kimlik numarasi", "kisitlama endorsmen restr", "odeme payment", "esas ucret base fare", "vergi tax", "toplam total")
DOCUMENT_KINDS = (
    ("elektronik bilet", "elektronik bilet yolcu seyahat belgesidir"), ("electronic ticket", "elektronik bilet yolcu seyahat belgesidir"), ("passenger itinerary", "elektronik bilet yolcu seyahat belgesidir"), ("seyahat belgesi", "seyahat belgesidir"),
    ("bilet", "bilettir"), ("anket", "ankettir"), ("form", "formdur"), ("sozlesme", "sözleşmedir"), ("rapor", "rapordur"), ("kilavuz", "kılavuzdur"), ("yonerge", "yönergedir"), ("prosedur", "prosedürdür"),
)

# Turkish noun endings without diacritics, outermost group first: copula, case, possessive, plural. Single
# vowels are not among them, as many stems end in one.
SUFFIX_RULES = (
    ("dir", "dur", "tir", "tur"),
    ("ndan", "nden", "dan", "den", "tan", "ten", "nda", "nde", "da", "de", "ta", "te", "nin", "nun", "in", "un", "yla", "yle", "ya", "ye", "yi", "yu"),
    ("imiz", "umuz", "iniz", "unuz", "lari", "leri", "si", "su", "im", "um", "in", "un"),
    ("lar", "ler"),
)
