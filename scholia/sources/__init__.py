"""Reading and writing corpora, bibliographies, extractions and reports."""
