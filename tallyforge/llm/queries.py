"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import secrets

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, importance_resampling, line_dedup, line_quality, lm_scoring, minhash_join, mixing, packing, periodic_runs, pii_surrogates, secret_scan, toxicity
from .common import crc_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_fold(F.col("doc_id"), 3) != 1))
    found = toxicity.score(docs, model, threshold=0.7)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), memo_bytes=224 << 20)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents"), secret=surrogate_key(spark))


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret that the session's configuration names; without one a secret of this run, which nobody keeps."""
    said = spark.conf.get("spark.tallyforge.surrogateKey", None)
    return said.encode() if said else secrets.token_bytes(32)


def op4_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_offset_aligned_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    rendered = chat_format.render_conversations(turns.unionByName(extra), chat_format.Formatter(byte_tokenizer()))
    return chat_format.read_back(rendered)


def op6_line_sequence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_quality.train(*line_quality.training_rows(docs, labels, most=4000))
    return line_quality.judge(docs, model).drop("content")


def op7_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(table(spark, sf_dir, "documents"), threshold=2)


def op8_backoff_automaton_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 10) != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def mix_plan(docs: DataFrame, **options) -> mixing.Plan:
    """Domains by the number in the source's name; weights of the production mix."""
    domain = F.concat(F.lit("d"), F.coalesce((F.expr("try_cast(substring(source, 4) AS INT)") % 4).cast("string"), F.lit("")))
    weights = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
    return mixing.Plan({"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, weights, **options)


def op9_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.copies(docs, mix_plan(docs, budget_percent=60, max_epochs=2, seed=7))


def op10_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def repeated(docs: DataFrame) -> DataFrame:
    """docs, where one document in ten, by its doc_id, ends in a block of its words over and over; null ids have none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def text(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda x: x.cast("int")
        block = F.slice(w, at(a + 1), at(p))
        rest = F.slice(F.flatten(F.array_repeat(block, at(F.ceil((n - a) / p)))), 1, at(n - a))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, at(a)), rest), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform(F.array(words), text)[0]
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(repeated(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("p"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), said.alias("said"), "collapsed")
    return found.select(
        "doc_id", "n_runs", (-F.col("m.back")).alias("start"), "m.length", (-F.col("m.p")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.p")).alias("exponent_milli"), F.sha2(F.col("said").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, n=3, buckets=10_000, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    base = secret_scan.listed(of(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

def _fill_sql(level: str, parents: list[str], children: str, budgets: str) -> str:
    """Shares of the children of one level; children has most and weight, budgets the parents' budgets."""
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    using = f"JOIN {budgets} b USING ({', '.join(parents)})" if parents else f"CROSS JOIN {budgets} b"
    return f"""
{level}_a AS (
  SELECT c.*, b.budget, sum(most) OVER w - most AS before_it, sum(weight) OVER ({part}) - sum(weight) OVER w + weight AS from_here
  FROM {children} c {using}
  WINDOW w AS ({part} ORDER BY most / weight, {level} ROWS UNBOUNDED PRECEDING)
), {level}_b AS (
  SELECT *, most * from_here <= weight * (budget - before_it) AS is_full FROM {level}_a
), {level}_c AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN most END) OVER ({part}), 0) AS taken,
         coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}), 0) AS shared FROM {level}_b
), {level}_given AS (
  SELECT {', '.join([*parents, level])}, CASE WHEN is_full THEN most ELSE ((budget - taken) * weight) // shared END AS budget FROM {level}_c
)"""


OP9_SQL = f"""
WITH docs AS (
  SELECT doc_id, 'd' || coalesce(CAST(TRY_CAST(substr(source, 4) AS INT) % 4 AS VARCHAR), '') AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM docs GROUP BY ALL),
root AS (SELECT sum(supply) * 60 // 100 AS budget FROM leaf),
domains AS (SELECT domain, sum(supply) * 2 AS most, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY ALL),
langs AS (SELECT domain, lang, sum(supply) * 2 AS most, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY ALL),
sources AS (SELECT domain, lang, source, sum(supply) * 2 AS most, CASE source WHEN 'src0' THEN 3 ELSE 1 END AS weight FROM leaf GROUP BY ALL),
{_fill_sql("domain", [], "domains", "root")},
{_fill_sql("lang", ["domain"], "langs", "domain_given")},
{_fill_sql("source", ["domain", "lang"], "sources", "lang_given")},
quota AS (
  SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS room
  FROM leaf JOIN source_given USING (domain, lang, source)
), run AS (
  SELECT doc_id, domain, lang, source, epochs, room,
         sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7/' || CAST(epochs AS BIGINT) || '/' || doc_id), doc_id RANGE UNBOUNDED PRECEDING) AS upto
  FROM docs JOIN quota USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, CAST(least(2, epochs + CASE WHEN upto <= room THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM run
"""

#: Of each turn the template takes 23 characters, and each place where `<` and `|` meet or backslashes part them one more.
OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS loss,
         sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

OP10_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY coalesce(text, '')
), worded AS (
  SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM worded
), sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
met AS (
  SELECT a.id AS a, b.id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 10 * m >= 8 * (x.n + y.n - m)
), reach AS (
  SELECT id, id AS other FROM texts UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.id = t.id LEFT JOIN counts n ON n.id = t.id
"""

def _crc_row(i: int) -> int:
    """What the half byte i adds to a checksum."""
    for _ in range(4):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def _crc32_sql(text: str, hexed: str) -> str:
    """crc32 of a text whose bytes in hexadecimal are hexed, half byte by half byte, the low one of a byte first."""
    digit = f"strpos('123456789ABCDEF', substr({hexed}, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1))"
    table = f"[{', '.join(str(_crc_row(i)) for i in range(16))}]"
    steps = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(2 * strlen({text})), lambda i: {digit}))"
    return f"xor(list_reduce({steps}, lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS said FROM documents
), hashed AS (SELECT *, len(w) AS n, {_crc32_sql("said", "hex(encode(said))")} AS h FROM docs),
cut AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, coalesce(h % 10 = 0, false) AND n > 0 AS planted FROM hashed),
planted AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
words AS (
  SELECT r, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS v
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)
), texts AS (SELECT r, n, list(v ORDER BY i) AS w FROM words GROUP BY r, n),
grid AS (
  SELECT r, n, w, p, unnest(range(0, n - 3 * p, p)) AS i FROM (SELECT r, n, w, unnest(range(1, n // 4 + 1)) AS p FROM texts)
), seen AS (
  SELECT DISTINCT r, n, p FROM grid WHERE w[i + 1] = w[i + p + 1] AND w[i + p + 1] = w[i + 2 * p + 1] AND w[i + 2 * p + 1] = w[i + 3 * p + 1]
), far AS (
  SELECT r, p, i FROM (
    SELECT s.r, s.p, s.n, a.i, a.v AS x, b.v AS y FROM seen s JOIN words a ON a.r = s.r LEFT JOIN words b ON b.r = s.r AND b.i = a.i + s.p
  ) WHERE i < n - p AND x <> y
  UNION ALL SELECT r, p, -1 FROM seen UNION ALL SELECT r, p, n - p FROM seen
), gaps AS (
  SELECT r, p, i + 1 AS start, lead(i) OVER (PARTITION BY r, p ORDER BY i) + p AS stop FROM far
), runs AS (
  SELECT r, start, stop - start AS length, min(p) AS period FROM gaps WHERE stop - start >= greatest(6, 4 * p) GROUP BY r, start, stop
), of_runs AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said,
         arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS m
  FROM runs GROUP BY r
), covered AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
short AS (
  SELECT r, string_agg(v, ' ' ORDER BY i) AS said FROM words ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(m.start AS BIGINT) AS start, CAST(m.length AS BIGINT) AS length, CAST(m.period AS BIGINT) AS period,
       CAST(1000 * m.length // m.period AS BIGINT) AS exponent_milli, sha256(coalesce(o.said, '')) AS runs_sha256, sha256(coalesce(s.said, '')) AS collapsed_sha256
FROM docs d LEFT JOIN of_runs o USING (r) LEFT JOIN short s USING (r)
"""

OP12_SQL = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, 's' AS side, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), 't', 0, text FROM benchmark
), worded AS (
  SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM rows
), grams AS (
  SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                                     list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x FROM worded
), hexed AS (SELECT x, hex(encode(x)) AS b FROM (SELECT DISTINCT x FROM grams)),
coded AS (SELECT x, {_crc32_sql("x", "b")} % 10000 AS bucket FROM hexed),
counted AS (SELECT r, side, bucket, count(*) AS c FROM grams JOIN coded USING (x) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(c) FILTER (side = 's'), 0) AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums
), weighed AS (SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 's'
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS held FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= 5 * held // 100 THEN place END AS BIGINT) AS rank FROM scored LEFT JOIN placed USING (r)
"""

QUERIES = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_cost_balanced_packing": op2_cost_balanced_packing,
    "op3_keyed_surrogates": op3_keyed_surrogates,
    "op4_streaming_exact_dedup": op4_streaming_exact_dedup,
    "op5_offset_aligned_chat": op5_offset_aligned_chat,
    "op6_line_sequence_quality": op6_line_sequence_quality,
    "op7_segment_edit_join": op7_segment_edit_join,
    "op8_backoff_automaton_scores": op8_backoff_automaton_scores,
    "op9_hierarchical_mixing": op9_hierarchical_mixing,
    "op10_minhash_jaccard_join": op10_minhash_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_secret_scan": op13_secret_scan,
}

SQL = {
    "op4_streaming_exact_dedup": OP4_SQL,
    "op5_offset_aligned_chat": OP5_SQL,
    "op9_hierarchical_mixing": OP9_SQL,
    "op10_minhash_jaccard_join": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
