"""Odd rows: nulls everywhere, empty and long texts, repeated rows, clashing column names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, fp int, rows int, copy string, part int, size string, kept boolean"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "a"), (2, "The quick brown  fox\njumps over the lazy dog again and again", "a"), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"),
    (6, "one", "b"), (7, "one two three", None), (8, LONG, "b"), (9, LONG + " end", "b"), (9, LONG + " end", "b"), (None, "a null id text", "c"), (None, None, None),
    (12, "ＵＮＩ ſ K ▁ code é ß 中文 字 \U0001f600 text", "c"), (13, "x  y   z\r\n\r\n  w <|endoftext|> tail ", "c"), (14, "The quick brown fox jumps over the lazy dog again and again", "c"),
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "k", 1, 2, "c", 3, "s", True) for i, t, s in texts], SCHEMA)
