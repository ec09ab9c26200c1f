"""Statuses of compared texts, cells and code lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecon.functions.keys import compare_key, squeeze, strip_placeholder, tr_lower

# The two status lattices, in the order of their reports.
ITEM_STATUSES = ("AYNI", "SADECE_BİÇİM_FARKI", "PDF_DE_VAR_EXCELDE_YOK", "EXCELDE_VAR_PDF_DE_YOK", "YANLIŞ_BÖLÜM", "KOD_FARKLI", "METİN_FARKLI", "SAYI_FARKLI", "İNCELEME_GEREKLİ", "KAPSAM_DIŞI")
CELL_STATUSES = ("AYNI", "BİÇİM", "FARKLI", "YALNIZCA_SİSTEM", "YALNIZCA_PDF", "BOŞ")


def form_key(c: Column) -> Column:
    """Equal for texts that differ in form alone: compare key without white space, lower case."""
    return F.replace(tr_lower(compare_key(c)), F.lit(" "), F.lit(""))


def text_status(document: Column, sheet: Column) -> Column:
    """Of an item on both sides; an empty text against another is a different text."""
    a, b = F.coalesce(document, F.lit("")), strip_placeholder(sheet)
    return F.when(squeeze(a) == squeeze(b), "AYNI").when(form_key(a) == form_key(b), "SADECE_BİÇİM_FARKI").otherwise("METİN_FARKLI")


def cell_status(document: Column, sheet: Column) -> Column:
    """Of a cell; empty sides have statuses of their own."""
    a, b = squeeze(F.coalesce(document, F.lit(""))), squeeze(strip_placeholder(sheet))
    return (
        F.when((a == "") & (b == ""), "BOŞ").when(a == "", "YALNIZCA_SİSTEM").when(b == "", "YALNIZCA_PDF")
        .when(a == b, "AYNI").when(form_key(a) == form_key(b), "BİÇİM").otherwise("FARKLI")
    )


def merged_status(statuses: Column) -> Column:
    """Of several cells: all the same, or any difference, or form alone; empty ones are left out."""
    held = F.array_distinct(F.filter(statuses, lambda x: x != "BOŞ"))
    odd = F.exists(held, lambda x: ~x.isin("AYNI", "BİÇİM"))
    return F.when(F.size(held) == 0, "BOŞ").when(F.size(held) == 1, held[0]).when(odd, "FARKLI").otherwise("BİÇİM")
