"""The queries opN_ over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, bwt, cnn, codes, jaccard, langid, media, mixing, pii, rules, toxicity, variants
from .common import labelled_texts, remainder, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def secret(spark: SparkSession) -> str:
    """The key of pseudonyms: spark.corpus.pseudonym.key; where it is unset a fixed one, good for made-up data only."""
    return spark.conf.get("spark.corpus.pseudonym.key", None) or "made-up data only"


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text encoded and decoded again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary, drop=("text",))
    both = bpe.decode(coded, vocabulary)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data under pseudonyms."""
    return pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark)).select("doc_id", "text", "n_pii", "pii_kinds")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: five-word shingles, similarity of 0.75 or more."""
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_langid(spark: SparkSession, sf_dir: str, rows: int = 800) -> DataFrame:
    """Language of every text by a random field fitted on at most `rows` labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = docs.select("doc_id", "lang").where(remainder("doc_id", 4) != 2)
    seen = labelled_texts(docs.select("doc_id", "text"), labels, "doc_id", "lang", rows=rows)
    model = langid.train([t for t, _ in seen], [g for _, g in seen])
    found = langid.predict(docs.select("doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of all sources takes each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n"))
    mixed = mixing.mix(docs, size=F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str, rows: int = 4000) -> DataFrame:
    """Toxicity of every text, disguised words restored, by a model fitted on at most `rows` labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    seen = labelled_texts(docs, labels, "doc_id", "toxic", rows=rows)
    model = toxicity.train(toxicity.language_model(docs), [t for t, _ in seen], [y for _, y in seen])
    scored = toxicity.classify(docs, model, drop=("text",))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the weakly supervised rules for every text."""
    ruled = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return ruled.select("doc_id", *rules.BASE, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text kept as 8-bit samples, read back, sniffed; the declared type is deliberately text/plain, which sniffing corrects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), media.store_samples(media.padded(F.col("text"))).alias("medium"), F.lit("text/plain").alias("declared"))
    seen = media.sniff(docs, "medium", "declared").withColumn("payload", media.read_samples(F.col("medium")))
    inner = F.filter("media_items", lambda i: i["start"] > 0)
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("medium").cast("bigint").alias("media_bytes"),
        F.sha2("medium", 256).alias("media_sha256"),
        F.concat_ws(";", "media_type", F.concat(F.lit("hits="), F.col("media_hits").cast("string")), F.concat(F.lit("embedded="), F.array_join(F.transform(inner, lambda i: F.concat_ws(":", i["type"], i["start"].cast("string"), i["length"].cast("string"))), ","))).alias("feature"),
        F.col("media_was_wrong").alias("corrected"),
    )


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the bytes of repeated 200-byte strings."""
    return bwt.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str, rows: int = 1500) -> DataFrame:
    """Quality of every text by a network fitted on at most `rows` labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    seen = labelled_texts(docs, labels, "doc_id", "quality", rows=rows)
    model = cnn.train([t for t, _ in seen], [y for _, y in seen])
    scored = cnn.classify(docs, model, drop=("text",))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids, written as directly addressable codes in the shared folder and read back; digests of what was read."""
    path = codes.new_path(spark)
    codes.write(codes.coded(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS, end=2), path)
    return codes.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under two tokenizers: groups of tokens over the same bytes, links, and how common these are in the corpus."""
    found = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, PIECES, drop=("text",), hashed=True)
    return found.select("doc_id", *align.COUNTS, "n_best", "count_sum", F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of six letters and five occurrences or more with its near words, its form and its root."""
    return variants.group(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


#: (share, votes bad where, good where) of the nine rules, in their order.
_VOTES = [
    ("n_symbols/greatest(n_words, 1)", "x > 0.1", "x < 0.02"),
    ("n_repeat_words/greatest(n_words, 1)", "x > 0.25", "x < 0.1"),
    ("n_dup_lines/greatest(n_lines, 1)", "x > 0.3", "x < 0.1"),
    ("n_capitals/greatest(word_chars, 1)", "x > 0.3", "x < 0.1"),
    ("n_distinct/greatest(n_words, 1)", "x < 0.2", "x > 0.35"),
    ("n_shouts/greatest(n_words, 1)", "x > 0.1", "x < 0.02"),
    ("n_letters/greatest(word_chars, 1)", "x < 0.75", "x > 0.88"),
    ("n_bare/greatest(word_chars, 1)", "x > 0.05", "x < 0.02"),
    ("n_stops/greatest(n_words, 1)", "x < 0.004", "x > 0.01 AND x < 0.4"),
]


def _rules_sql() -> str:
    """The statistics, votes and sixty rounds of expectation-maximisation as one statement: the state is a row of lists (probability of each vote of each rule for good and for bad texts), joined with the counted vote patterns in each round."""
    vote = lambda share, bad, good: f"CASE WHEN {bad.replace('x', f'({share})')} THEN -1 WHEN {good.replace('x', f'({share})')} THEN 1 ELSE 0 END"
    mass = lambda p, prior: ", ".join(f"0.02*any_value(total)*{prior[x]} + sum(CASE WHEN v[{r}] = {x - 1} THEN n*{p} ELSE 0 END)" for r in range(1, 10) for x in range(3))
    odds = lambda of: f"ln({of}.share/(1-{of}.share)) + list_sum([ln({of}.g[3*r+v[r+1]+2]/{of}.b[3*r+v[r+1]+2]) for r in range(9)])"
    shares = lambda c: ", ".join(f"{c}[{3 * r + x + 1}]/({c}[{3 * r + 1}]+{c}[{3 * r + 2}]+{c}[{3 * r + 3}])" for r in range(9) for x in range(3))
    held = ", ".join(f"CASE WHEN g0[{3 * r + 1}] > 0.01 THEN {'0.01e0' if x == 0 else f'g0[{3 * r + x + 1}]*0.99e0/(1-g0[{3 * r + 1}])'} ELSE g0[{3 * r + x + 1}] END" for r in range(9) for x in range(3))
    first = lambda p: "[" + ", ".join(f"{x}e0" for _ in range(9) for x in p) + "]"
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w), z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM p),
q AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM z, range(3) r(k) WHERE c > 1 GROUP BY doc_id),
s AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(l) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_capitals, len(list_distinct(w)) AS n_distinct, coalesce(list_sum([length(x) - 1 for x in regexp_extract_all(t, '!+')]), 0) AS n_shouts, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS n_letters,
 coalesce(list_sum([length(x) for x in w if NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')]), 0) AS n_bare, len([x for x in w if regexp_matches(x, '[.?!]$')]) AS n_stops FROM w LEFT JOIN q USING (doc_id)),
d AS MATERIALIZED (SELECT *, [{', '.join(vote(*x) for x in _VOTES)}] AS v FROM s), h AS MATERIALIZED (SELECT v, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY v),
m AS (SELECT 0 AS k, 0.85e0 AS share, {first((0.02, 0.18, 0.80))} AS g, {first((0.40, 0.25, 0.35))} AS b UNION ALL
SELECT k, share, [{held}], b FROM (SELECT k, share, [{shares('g1')}] AS g0, [{shares('b1')}] AS b FROM (SELECT k + 1 AS k, (0.85e0*0.02*any_value(total) + sum(n*p))/(1.02e0*any_value(total)) AS share, [{mass('p', (0.02, 0.18, 0.80))}] AS g1, [{mass('(1-p)', (0.40, 0.25, 0.35))}] AS b1 FROM (SELECT m.k, h.v, h.n, h.total, 1/(1+exp(-({odds('m')}))) AS p FROM m, h WHERE m.k < 60) GROUP BY k))),
f AS (SELECT * FROM m WHERE k = 60), o AS (SELECT d.*, 1/(1+exp(-({odds('f')}))) AS p, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed FROM d, f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good FROM o"""


QUERIES = {"op1_bpe": op1_bpe, "op2_pii": op2_pii, "op3_jaccard": op3_jaccard, "op4_langid": op4_langid, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_rules": op7_rules, "op8_media": op8_media, "op9_suffixes": op9_suffixes, "op10_quality": op10_quality, "op11_codes": op11_codes, "op12_alignment": op12_alignment, "op13_variants": op13_variants}
#: Plain statements of the contracts, for tables of the size of the checks: pairs by common shingles and recursive links for op3, every 200-byte window for op9.
#: The others need models, tokenizers or formats that SQL has not; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
c AS MATERIALIZED (SELECT d.doc_id, count(s) AS n, coalesce(md5(string_agg(s, chr(10) ORDER BY s)), concat('none ', d.doc_id)) AS h FROM w d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id),
k AS MATERIALIZED (SELECT h, n, min(doc_id) AS class_id FROM c GROUP BY h, n),
r AS MATERIALIZED (SELECT k.class_id AS id, k.n, s FROM k JOIN g ON g.doc_id = k.class_id WHERE k.n > 0),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
v AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
m AS (SELECT class_id AS id, class_id AS least FROM k UNION SELECT v.b, m.least FROM m JOIN v ON v.a = m.id WHERE m.least < v.b)
SELECT c.doc_id, c.n AS n_shingles, l.least AS component_id, k.class_id FROM c JOIN k USING (h, n) JOIN (SELECT id, min(least) AS least FROM m GROUP BY id) l ON l.id = k.class_id""",
    "op5_mixing": r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(concat('11|', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source), w AS (SELECT *, ([5e0, 2e0, 1e0])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS wt, 3e0 * z AS cap FROM s),
l AS (SELECT *, (sum(z) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER f, 0)) AS lv FROM w WINDOW f AS (ORDER BY cap / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT source, z, least(cap, wt * (SELECT lv FROM l WHERE cap > lv * wt ORDER BY cap / wt, source ASC NULLS LAST LIMIT 1)) AS target FROM l),
e AS (SELECT *, CASE WHEN z > 0 THEN least(floor(target / z), 3) ELSE 0 END AS whole FROM v),
r AS (SELECT d.*, z, target, whole, CASE WHEN whole < 3 THEN target - whole * z ELSE 0 END AS rest, coalesce(sum(size) OVER p, 0)::BIGINT AS begun, row_number() OVER (PARTITION BY d.source ORDER BY h, size) - 1 AS rank FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source WINDOW p AS (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(max(CASE WHEN begun + size <= rest THEN rank + 1 END) OVER (PARTITION BY source), 0) AS ends FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, h) AS pos, rest - min(begun) OVER (PARTITION BY source) AS gap, min(rank) OVER (PARTITION BY source) AS head FROM b WHERE rest > 0 AND rank >= ends - 128 AND rank < ends + 128),
g AS (SELECT DISTINCT source, 0::BIGINT AS pos, -1::BIGINT AS rank, gap, false AS took, 0::BIGINT AS size FROM n UNION ALL SELECT n.source, n.pos, n.rank, CASE WHEN n.size <= g.gap THEN g.gap - n.size ELSE g.gap END, n.size <= g.gap, n.size FROM g JOIN n ON n.source IS NOT DISTINCT FROM g.source AND n.pos = g.pos + 1),
o AS (SELECT source, arg_max(gap, pos) AS gap, arg_max(rank, pos) FILTER (NOT took AND pos > 0) AS spare, arg_max(size, pos) FILTER (NOT took AND pos > 0) AS least FROM g GROUP BY source),
t AS (SELECT source, rank FROM g WHERE took UNION ALL SELECT source, spare FROM o WHERE least - gap < gap),
f AS (SELECT DISTINCT source, head FROM n)
SELECT doc_id, size, z AS source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM (SELECT r.*, CAST(whole + CASE WHEN r.rank < coalesce(f.head, 0) OR t.rank IS NOT NULL THEN 1 ELSE 0 END AS INT) AS copies FROM r LEFT JOIN f ON f.source IS NOT DISTINCT FROM r.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.rank = r.rank)""",
    "op9_suffixes": r"""WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(range(0, greatest(len(x)//2 - 199, 0))) AS i, x FROM t),
q AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2*i + 1, 400)) AS h FROM p),
d AS MATERIALIZED (SELECT h FROM q GROUP BY h HAVING count(*) > 1),
s AS MATERIALIZED (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS b FROM q JOIN d USING (h)),
g AS MATERIALIZED (SELECT doc_id, k, min(i) AS f, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
o AS MATERIALIZED (SELECT doc_id, sum(z - f) AS gone, count(*) AS spans, list({'f': f, 'z': z} ORDER BY f) AS r FROM g GROUP BY doc_id),
l AS (SELECT t.doc_id, len(x)//2 AS n, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans, CASE WHEN r IS NULL THEN x ELSE array_to_string(list_concat([substr(x, 1, 2*r[1].f)], [substr(x, 2*r[j].z + 1, 2*(coalesce(r[j+1].f, len(x)//2) - r[j].z)) for j in range(1, len(r) + 1)]), '') END AS y FROM t LEFT JOIN o USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM l""",
    "op7_rules": _rules_sql(),
    # the checksum byte by byte with its table of 256 words; near words by what is left without one letter
    "op13_variants": r"""WITH RECURSIVE k AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
y AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w))) AS b FROM x GROUP BY doc_id, w),
h AS MATERIALIZED (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [('0x' || substr(b, 2*i - 1, 2))::BIGINT for i in range(1, len(b)//2 + 1)]), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1]))) AS h FROM y, k),
o AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS BIGINT)), substr(w, CAST(h % length(w) AS BIGINT) + 2)) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS s FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
l AS MATERIALIZED (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.s),
e AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
f AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, b) AS b, max(v.n) AS m FROM e JOIN v ON v.word = e.b GROUP BY a),
g AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN b END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, word AS "at", 0 AS k FROM g UNION ALL SELECT r.word, g.form, k + 1 FROM r JOIN g ON g.word = r."at" WHERE g.form IS NOT NULL)
SELECT g.*, root FROM g JOIN (SELECT word, arg_max("at", k) AS root FROM r GROUP BY word) USING (word)""",
}
