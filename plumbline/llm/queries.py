"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import fingerprint, lines, lmscore, mixing, packing, pii, quality, secrets, simhash, tokens
from plumbline.llm.shared import n_words_of, read_table, stored


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie; they are installed wherever the job runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), tokenizer_file("word_bpe_49k.json"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("d.doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(read_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", mixing.document_key(F.col("doc_id"), F.col("text")).alias("id"), "source", n_words_of(F.col("text")).alias("size")), "mix-sizes")
    taken = mixing.mix(sizes.select(F.struct("doc_id").alias("row"), "id", "source", "size"), narrow=sizes)
    return taken.select("row.doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(read_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.pieces_of(tokenizer_file("piece_bpe_32k.model")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_score, op2_pack_sequences, op3_quality_rules, op4_secret_scan, op5_mix_sources, op6_fingerprint, op7_personal_data, op8_simhash_dedup, op9_token_counts, op10_line_dedup)}

#: SQL of the queries that SQL can express.
RULES_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS times FROM places),
twice AS (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS gap FROM windows WHERE times > 1),
covered AS (SELECT doc_id, sum(least(8, gap)) AS n FROM twice GROUP BY doc_id),
c AS (SELECT w.doc_id, t, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.1 * n_words
  OR length(t) - length(regexp_replace(t, '[!?]+', '', 'g')) > 0.3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > len(lines)
  OR length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) > 0.4 * word_chars OR len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 0.7 * n_words
  OR len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > 0.2 * n_words
  OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.3 * len(lines)) AS kept FROM f"""


def secrets_sql() -> str:
    """Starts are sums of the lengths of what stands before; entropies are those of every window."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [(k, p, g, n) for k, (p, g, n) in secrets.BASE.items()] + [("entropy", secrets.CANDIDATE.removesuffix("+"), 0, secrets.WINDOW)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, {quote(k)} AS kind, {n} AS least, regexp_extract_all(t, {quote(p)}) AS m, regexp_extract_all(t, {quote(p)}, {g}) AS inner_part, string_split_regex(t, {quote(p)}) AS gaps FROM d WHERE regexp_matches(t, {quote(p)})" for i, (k, p, g, n) in enumerate(kinds)
    )
    limits = secrets.THRESHOLD
    n = secrets.WINDOW
    allowed = quote("(?i)" + secrets.ALLOWED.removeprefix("(?i)"))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM f),
s AS (SELECT doc_id, k, kind, m[j] AS part, CAST(list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e WHERE length(inner_part[j]) >= least),
p AS (SELECT *, a + length(part) AS b FROM s),
z AS (SELECT *, array_to_string(list_transform(string_split(part, '/'), lambda x: CASE WHEN regexp_matches(x, {allowed}) THEN repeat(' ', length(x)) ELSE x END), '/') AS seen FROM p WHERE k = 3),
x AS (SELECT * FROM z p WHERE regexp_matches(seen, '[0-9].*[0-9]') AND regexp_matches(seen, '[A-Za-z].*[A-Za-z]')
  AND len(list_filter(list_transform(range(1, length(seen) - {n - 2}), lambda i: substr(seen, i, {n})), lambda w: NOT contains(w, ' ')
  AND list_entropy(string_split(w, '')) >= CASE WHEN regexp_full_match(w, '[0-9a-f]+|[0-9A-F]+') THEN {limits["hex"]} WHEN regexp_full_match(w, '[0-9a-z]+|[0-9A-Z]+') THEN {limits["single"]} ELSE {limits["wide"]} END - 1e-9)) > 0
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.k < 3 AND o.a <= p.a AND o.b >= p.b)),
y AS (SELECT doc_id, k, kind, a, b FROM p WHERE k < 3 UNION ALL SELECT doc_id, k, kind, a, b FROM x),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {"op3_quality_rules": RULES_SQL, "op4_secret_scan": secrets_sql()}
