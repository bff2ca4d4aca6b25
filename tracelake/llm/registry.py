"""The corpus queries: each operator over its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, egojoin, lm, merkle, mixing, packing, pii, quality, simhash, url_filter, warc
from .common import join_spread, materialize, new_path, table
from .tokens import tokenizer_path

HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Globs judged where no host rule fits.
GLOB_RULES = [("*.ads.**", "block"), ("*.tracker.**", "block"), ("**/login*", "block"), ("**/cart/*", "block"), ("**.exe", "block"), ("**.zip", "block"), ("*.org/**", "allow")]


def url_rules() -> list[url_filter.Rule]:
    return [url_filter.host_rule(r, v) for r, v in HOST_RULES] + [url_filter.Rule(g, g, v, len(g)) for g, v in GLOB_RULES]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules decide and are named; where only a glob matched, its verdict holds and rule is null."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules())
    host_rules = [r for r, _ in HOST_RULES]
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(host_rules), F.col("rule")).alias("rule"), "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(line(F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares proportional to the square root of each source's rows, one epoch in all."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "copy", "copies", "shuffle_key")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    got = warc.read_archives(spark, path)
    records = materialize(got.select(F.col("page_id").cast("long").alias("page_id"), F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), F.sha1("payload").alias("own"), "payload_digest", "payload_bytes"), "records")
    if lost := records.where("record_type = 'gap'").count():
        raise RuntimeError(f"{lost} stretches of the archives could not be read")
    named = records.withColumn("key", F.concat_ws(":", "refers_to", "payload_digest"))
    revisits = named.where("record_type = 'revisit'")
    kept = records.where("record_type = 'response'").groupBy(F.concat_ws(":", "page_id", "own").alias("key")).agg(F.max("payload_bytes").alias("full"))
    full = join_spread(revisits, revisits.groupBy("key").agg(F.count("*").alias("n")).join(kept, "key"), "key", "left")
    stored = records.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("own").alias("payload_digest"), "record_type", "refers_to")
    return stored.unionByName(full.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    items = F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256")
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), items, (F.col("leak.n_hit") > 0).alias("contaminated"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"), least=30, top=2000, share=80)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, checked for what the tampered dataset holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    leaf = lambda text: merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    proved = merkle.prove(merkle.build_manifest(docs, "doc_id", "lang", leaf(F.col("text")), leaf(tampered)))
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_packing, op4_pii, op5_ann, op6_quality, op7_mixing, op8_embedding_near_dedup, op9_lm_scoring, op10_warc, op11_decontamination, op12_collocations, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _OP1,
        "op7_mixing": _OP7,
        "op10_warc": _OP10,
        "op11_decontamination": _OP11,
        "op12_collocations": _OP12,
        "op13_merkle": _OP13,
    }


_OP1 = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE
    WHEN regexp_matches('.' || host || path, '^[^/]*\.tracker\.') THEN 'block'
    WHEN regexp_matches('.' || host || path, '^[^/]*\.ads\.') THEN 'block'
    WHEN regexp_matches('.' || host || path, '^[^/]*\.org/') THEN 'allow'
    WHEN contains('.' || host || path, '/login') OR contains(path, '/cart/') OR ends_with('.' || host || path, '.exe') OR ends_with('.' || host || path, '.zip') THEN 'block'
    ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f USING (page_id)
"""

_OP7 = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS all_n, sum(sqrt(n)) AS all_want FROM counts),
rates AS (SELECT source, sqrt(n) / all_want * all_n / n AS rate FROM counts, totals),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), total + exp(lp + ln(rate) - ln(k + 1)) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (
  SELECT doc_id, source, text, (CAST('0x' || substr(md5('7:' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.text, CAST(count(*) AS INTEGER) AS copies FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= d.u
  GROUP BY d.doc_id, d.source, d.text)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, copies, md5('7-order:' || doc_id || ':' || copy) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(copies)) AS copy)
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM b, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
spot AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM d, (SELECT DISTINCT size FROM win), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
found AS (SELECT doc_id, i, size, item_id FROM spot JOIN win USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + size)) AS k) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM c WHERE k > 1 AND f >= 30),
cuts AS (SELECT x.lang, x.k, x.phrase, x.a, cut, l.f AS l, r.f AS r, CAST(2000000 * CAST(x.a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) x
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(s[1:cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(s[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_of AS (SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(2, k)) AS m FROM cand) y, LATERAL (SELECT unnest(range(1, k - m + 2)) AS i) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN inner_of o ON o.lang = b.lang AND o.phrase = b.phrase JOIN t ON t.lang = b.lang
WHERE o.longer IS NULL OR CAST(100 AS HUGEINT) * o.longer < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_OP13 = f"""
WITH RECURSIVE said AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN {_LOW.format("text")} ELSE text END AS told FROM documents),
leaf AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p,
  sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "told"))}) AS claim FROM said),
tree(lang, lv, p, h) AS (SELECT lang, 0, p, leaf FROM leaf
  UNION ALL SELECT lang, any_value(lv) + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) WHERE n > 1 GROUP BY lang, p // 8),
sub AS (SELECT lang, arg_max(h, lv) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM tree GROUP BY lang),
top(lv, p, h) AS (SELECT 0, p, subroot FROM sub
  UNION ALL SELECT any_value(lv) + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY p // 8),
runs AS (SELECT 1 AS t, lang, lv, p // 8 AS q, list(h ORDER BY p) AS kids FROM (SELECT *, count(*) OVER (PARTITION BY lang, lv) AS n FROM tree) WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 2, NULL, lv, p // 8, list(h ORDER BY p) FROM (SELECT *, count(*) OVER (PARTITION BY lv) AS n FROM top) WHERE n > 1 GROUP BY ALL),
climb(doc_id, lang, lv, p, h, proof) AS (SELECT doc_id, lang, 0, p, claim, '' FROM leaf
  UNION ALL SELECT doc_id, c.lang, c.lv + 1, p // 8, sha256(array_to_string(kids[1:p % 8], '') || h || array_to_string(kids[p % 8 + 2:], '')), proof || array_to_string(kids[1:p % 8], '') || array_to_string(kids[p % 8 + 2:], '')
  FROM climb c JOIN runs r ON r.t = 1 AND r.lang IS NOT DISTINCT FROM c.lang AND r.lv = c.lv AND r.q = c.p // 8),
at_sub AS (SELECT doc_id, lang, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof FROM climb GROUP BY ALL),
up(doc_id, lv, p, h, proof) AS (SELECT doc_id, 0, p, h, proof FROM at_sub JOIN sub ON sub.lang IS NOT DISTINCT FROM at_sub.lang
  UNION ALL SELECT doc_id, c.lv + 1, p // 8, sha256(array_to_string(kids[1:p % 8], '') || h || array_to_string(kids[p % 8 + 2:], '')), proof || array_to_string(kids[1:p % 8], '') || array_to_string(kids[p % 8 + 2:], '')
  FROM up c JOIN runs r ON r.t = 2 AND r.lv = c.lv AND r.q = c.p // 8),
done AS (SELECT doc_id, arg_max(h, lv) AS folded_root, sha256(arg_max(proof, lv)) AS proof_sha256 FROM up GROUP BY doc_id),
root AS (SELECT arg_max(h, lv) AS root FROM top)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang JOIN done USING (doc_id), root
"""
