"""Rows that every operator must take: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, copies int, _key int"


def odd_documents(spark, more=()):
    line = "The quick brown fox of the hill jumps over the lazy dog and runs to the river in the morning light. "
    texts = [
        None, "", " \t\n", "one", "one two three four", line * 3, line * 3, line.upper() * 3, "x" * 3000, line * 200,
        "Zeile eins der Datei\nZeile eins der Datei\n\nund noch eine andere Zeile im Text", "naïve café 😀 " * 30, "a b   c\x1cd  e\r\n\r\n f's",
        *more,
    ]
    rows = [(i, t, "en", ("b", "a", None)[i % 3], None if t is None else len(t), "x", "y", 3, 9) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
