"""Small inputs that every operator must handle: nulls, empty and long texts, ties, repeats, clashing names."""

WORDS = "The of and entre Über ção para 42 the% idiot an1 zu x".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(30_000))


def documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 0),
        (2, base, "en", "a", 0),
        (2, base, "en", "a", 0),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "en", "b", 0),
        (6, LONG, "de", "c", 1),
        (7, base + " tail", "fr", None, 1),
        (None, "short text", "en", "a", 2),
        (8, "password: abc token=secret1234 " + base, "en", "", 3),
        (9, "\U0001f600 Ünï " + base.upper(), "en", "b", 3),
        (10, "x", "en", "b", 3),
    ]
    # extra columns whose names operators may use inside
    return spark.createDataFrame([r + (7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start long, row_key string")


def empty(spark):
    return documents(spark).limit(0)


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda t: [(x is None, str(type(x)), x if not isinstance(x, (list, tuple)) else str(x)) if x is not None else (True, "", 0) for x in t])
