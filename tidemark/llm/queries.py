"""One query per operator over the driver's tables, and the SQL of those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, divergence, exact_dedup, jaccard, line_quality, lm, merkle, mixing, sentencepiece, spelling, token_counts, toxicity, urlfilter
from tidemark.llm.common import crc_fold

VOCABULARIES = "/opt/tokenizers"  # a parameter of every operator that takes a vocabulary
PIECES = f"{VOCABULARIES}/piece_bpe_32k.model"
RANKS = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
# The rules of the URL query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TOXIC_AT = 0.3
HELD_TOXIC, HELD_LM = (4, 2), (7, 2)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # batches by bytes as well as rows: texts may be very long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, PIECES).select("doc_id", "ids", "n_tokens", "path_score", "round_trip")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference records of all conversations: chosen is the conversation up to its last assistant turn; rejected has the
    last assistant turn of the other conversation of its pair (2k, 2k+1) there, or nothing if that one has none."""
    turns = read(spark, sf_dir, "conversations")
    rows = chat.conversations_as_rows(turns)
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.coalesce(F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), F.lit(True)), F.lit(0)).cast("int") + 1
    rows = rows.where(F.exists("turns", lambda t: t["role"] == "assistant")).select("conv_id", F.slice("turns", F.lit(1), last).alias("chosen"), F.element_at(said, -1).alias("answer"))
    other = rows.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("foil"))
    pairs = rows.join(other, "conv_id", "left")
    foil = F.when(F.col("foil").isNull(), F.array().cast(pairs.schema["chosen"].dataType)).otherwise(F.array("foil"))
    pairs = pairs.withColumn("rejected", F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), foil))
    out = chat.preferences(pairs.select("conv_id", "chosen", "rejected"))
    return out.select("conv_id", "prompt_turns", "prompt", "chosen_completion", chat.runs(F.col("chosen_mask")).alias("chosen_mask"), "rejected_completion", chat.runs(F.col("rejected_mask")).alias("rejected_mask"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, likeness of 0.75 or more."""
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return merkle.fingerprints(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labelled rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), mod=HELD_TOXIC[0], held_fold=HELD_TOXIC[1])
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_fold("doc_id", HELD_TOXIC[0]) == HELD_TOXIC[1]).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the subword lattice, and under add-one word counts."""
    docs = read(spark, sf_dir, "documents")
    held = crc_fold("doc_id", HELD_LM[0]) == HELD_LM[1]
    out = lm.lm_scores(docs, PIECES, train=~held, class_col="lang")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with totals for every context limit."""
    lengths = token_counts.encoded_lengths(read(spark, sf_dir, "documents").select("text"), RANKS)
    return token_counts.length_histogram(lengths)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents to target weights takes of each, repeats counted."""
    queue = mixing.queued(read(spark, sf_dir, "documents"))
    taken = mixing.mixed(queue).groupBy("id", "source", "row_key", "nth", "cum", "size", "source_size", "target").agg(
        F.sum("taken").alias("taken"), F.max(F.when(F.col("taken") > 0, F.col("virtual_finish"))).alias("virtual_finish")
    )
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "virtual_finish")


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether enough of it is content by the labelled lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crf = line_quality.learn(docs, read(spark, sf_dir, "labels"))
    return line_quality.line_quality(docs, crf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the far commoner near word it may be a variant of, and the root of its chain."""
    words = spelling.corpus_words(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.spelling_groups(words)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and its 200 most telling terms."""
    return divergence.divergence(read(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_chat, op3_jaccard_join, op4_merkle, op5_exact_dedup, op6_toxicity, op7_url_filter, op8_lm_score, op9_token_counts, op10_mix,
    op11_line_quality, op12_spelling, op13_divergence,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TURN = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"
_SPANS = """list_aggregate(list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i].role = 'assistant'),
  lambda i: (coalesce(list_sum(list_transform({t}[1:i - 1], lambda x: length({turn}))), 0) + length({t}[i].role) + 5)::BIGINT::VARCHAR || ':' || (length({t}[i].text) + 8)::VARCHAR), 'string_agg', ',')"""


def _spans(t: str) -> str:
    return f"coalesce({_SPANS.format(t=t, turn=_TURN)}, '')"


def _render(t: str) -> str:
    return f"coalesce(list_aggregate(list_transform({t}, lambda x: {_TURN}), 'string_agg', ''), '')"


ORACLES = {
    "op2_chat": f"""
WITH c AS (SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS l FROM c),
r AS (SELECT conv_id, turns[1:l] AS chosen, turns[1:l - 1] AS head, turns[l] AS answer FROM a WHERE l IS NOT NULL),
p AS (SELECT r.conv_id, r.chosen, CASE WHEN o.conv_id IS NULL THEN r.head ELSE list_append(r.head, o.answer) END AS rejected
      FROM r LEFT JOIN r o ON o.conv_id = xor(r.conv_id, 1)),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
        lambda i: chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1, least(len(chosen), len(rejected))) AS n FROM p),
s AS (SELECT conv_id, n, chosen[1:n] AS pt, chosen[n + 1:] AS ct, rejected[n + 1:] AS rt FROM q)
SELECT conv_id, n::INTEGER AS prompt_turns, {_render('pt')} AS prompt, {_render('ct')} AS chosen_completion, {_spans('ct')} AS chosen_mask,
  {_render('rt')} AS rejected_completion, {_spans('rt')} AS rejected_mask FROM s""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""",
    "op7_url_filter": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(gc.n, 0) AS n, 1 + 1000000000 * (coalesce(gc.n, 0) + 1) // (gn.total + v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn USING (lang, source) LEFT JOIN gc USING (lang, source, term)),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 1) // (any_value(ln.total) + any_value(v.v)) AS q FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
e AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT * FROM o UNION ALL SELECT * FROM e),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM y WHERE part = 'pair' OR rank <= 200""",
}
