def rows_of(spark):
    """An exact copy (1, 2), a near copy (2, 3), clean texts, and texts without a letter."""
    base = " ".join(f"word{k}" for k in range(80))
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("word79", "other"), "en", "a"), (4, "el perro come en la casa " * 3, "es", "a"), (5, "the dog eats in the house", "en", None), (6, "der Hund", "de", "b"), (7, None, "en", "a"), (8, "123 %%", "en", "b")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, extra string")
