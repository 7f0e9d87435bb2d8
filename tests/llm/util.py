"""Small tables with the cases that every operator has to bear."""

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "the cat\tsat on the mat, it's 12 o'clock.\n\nThe end",
    "the cat\tsat on the mat, it's 12 o'clock.\n\nThe end",
    "ÉCOLE straße ñandú    12½ 漢字 🙂🙂 é",
    "x" * 5000,
    "ab " * 3000,
    "  lead and trail  ",
    "don't we'll '' 'sta ́mark <|endoftext|> \x1c\x85   end",
]


def odd_documents(spark):
    """Null, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i, i) for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int, part int")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def save(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)
