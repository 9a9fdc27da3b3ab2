import pyarrow.dataset as ds

SF = "/root/testdata/sf0.001"
#: Texts that every operator on texts has to take.
ODD = [
    None, "", " ", "\n", "a", "a  b", "x \n \n y", "tab\there", "nul\0byte", "é́ combining", "😀 emoji 👍🏽 x",
    "I'm don't 'stuff' 12 34,56 ... a..b", "<|endoftext|> a<|startoftext|>", "ÉCOLE Été", " nbsp  wide", "same text", "same text",
    "word " * 3000, "日本語のテキスト。", "end ",
]


def documents(n=None):
    rows = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows][:n]


def odd_frame(spark, **extra):
    """Every odd text, a repeated row, a null doc_id, and columns whose names clash with operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n"), (None, "no id here")]
    columns = ["part", "seg", "length", "start", "n", "h", "_rank", "band", "sha"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(d, t, *["x"] * len(columns)) for d, t in rows], schema), rows


def empty_frame(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
