"""Plumbline: grounded document question answering as Spark jobs over tables of documents and questions."""
