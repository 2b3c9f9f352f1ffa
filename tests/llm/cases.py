"""Documents with everything that the operators must bear."""

import random

#: Names that operators use inside, as extra columns of documents.
CLASHING = ["row", "digest", "keep_id", "node", "hit_id", "near_id", "judged_text", "copies", "leaf_supply", "label_id", "y", "key", "slice", "n_tokens", "domain", "block", "kind", "train", "draws", "line", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def edge_rows():
    rng = random.Random(7)
    long = words(rng, 30_000)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, " ".join(near), "en", "src1"), (4, None, "en", "src1"), (5, "", "de", "src2"),
        (6, "   \n\t ", "de", None), (7, long, None, "src3"), (8, words(rng, 3), "fr", "src0"), (9, base.upper(), "en", "src9"),
        (9, base.upper(), "en", "src9"), (None, words(rng, 80), "en", "src0"), (None, None, None, None), (10, "One line here it is\nOne line here it is\n" + words(rng, 60), "es", "srcx"),
        (11, "ünïcödé 你好 \U0001f600 \x00 \x1c end " * 30, "xx", "src4"),
    ]
    return [(i, t, lang, src, len(t) if t else None, *[f"{c}-{i}" for c in CLASHING]) for i, t, lang, src in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
