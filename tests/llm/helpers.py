"""Documents for the edge cases, and small things that the tests share."""

LANG = {"en": "the quick brown fox jumps over the lazy dog and then it runs away from the old house", "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann vom alten haus weg"}


def odd_rows(text: str):
    """Nulls, empty and white texts, a long text, ties and repeated rows."""
    return [
        (1, text, "en"),
        (1, text, "en"),  # a repeated row
        (2, text, None),
        (3, None, "en"),
        (4, "", "en"),
        (5, "  \n\t ", "de"),
        (None, text, "en"),
        (6, (LANG["de"] + ". ") * 2000, "de"),
        (7, "!!! ??? ...", "en"),
        (8, LANG["de"], "de"),
    ]


def odd_docs(spark, text=LANG["en"], extra=True):
    rows = odd_rows(text)
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ["h", "line", "src", "band", "bands", "sig", "node", "root", "leader", "n", "DOC_ID", "_c0", "key", "at", "_gone", "_id", "_blocks", "_new", "group_id", "removed", "bucket"]
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in clash))


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
