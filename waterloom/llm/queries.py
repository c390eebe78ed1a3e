"""The operators on the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waterloom.llm import (
    codes, langid, licenses, lm, media, packing, quality, shards, simhash, tokens, trie, urls,
    winnow,
)
from waterloom.llm.common import id_remainder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


@query("op9_token_counts")
def op9_token_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        tokens.token_count("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > 2048)


WORDS5 = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op5_decontamination", f"""WITH d AS (SELECT doc_id, {WORDS5} AS w FROM documents),
it AS (SELECT item_id, {WORDS5} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS s, w[i:i + least(len(w), 13) - 1] AS x
 FROM it, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, i, w[i:i + s - 1] AS x FROM d, (SELECT DISTINCT s FROM iw),
 unnest(range(1, len(w) - s + 2)) t(i)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.s FROM dw JOIN iw ON dw.x = iw.x),
hw AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, s)) t(j) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT
 item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
 coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""")
def op5_decontamination(spark, d):
    return winnow.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op6_packing")
def op6_packing(spark, d):
    return packing.packed(table(spark, d, "documents"))


@query("op1_simhash_groups")
def op1_simhash_groups(spark, d):
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


@query("op2_language_id")
def op2_language_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"),
                      langid.predict(spark, model, "text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op3_quality")
def op3_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, d, "labels").where(~held_out)
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", held_out.alias("held_out"),
                      quality.score(spark, model, "text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op8_media_columns")
def op8_media_columns(spark, d):
    index = media.store(table(spark, d, "documents"))
    return media.read_back(index, index.media_root)


@query("op10_lm_scores")
def op10_lm_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False))
    model = lm.fit(docs, ~held_out)
    return lm.score(docs, model, held_out=held_out)


@query("op4_license_scan")
def op4_license_scan(spark, d):
    found = licenses.scan(table(spark, d, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"])))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.concat_ws(",", names).alias("licenses"),
        F.array_max(F.transform("matches", lambda m: m["containment"])).alias("containment"))


@query("op7_token_shards")
def op7_token_shards(spark, d):
    return shards.token_shards(table(spark, d, "documents"))


@query("op11_url_filter")
def op11_url_filter(spark, d):
    return urls.judge(table(spark, d, "pages"))


def _code_rounds(rounds: int) -> str:
    """Assignments a0, a1 ... (part p of vector vec_id: distance * 64 + entry) and codebooks b1 ..."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS (SELECT x.vec_id, x.label, x.n, x.p, any_value(x.v) AS v, min(64 *
 list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
 + b.e) AS m FROM x JOIN b{r} b USING (p) GROUP BY ALL)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT p, m % 64 AS e, i, sum(v[i])::DOUBLE / count(*) AS mean
 FROM a{r}, unnest(range(1, len(v) + 1)) t(i) GROUP BY ALL),
c{r} AS (SELECT p, e, list(floor(mean)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY ALL),
b{r + 1} AS (SELECT p, e, coalesce(c{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN c{r} USING (p, e))""")
    return ",\n".join(out)


@query("op12_vector_codes", f"""WITH k AS (SELECT vec_id, label, row_number() OVER () AS n,
 list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE embedding IS NOT NULL
 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
x AS (SELECT vec_id, label, n, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS v
 FROM k, unnest(range(16)) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x
 QUALIFY e < 64),
{_code_rounds(2)},
r AS (SELECT vec_id, label, n, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code,
 sum(m // 64)::BIGINT AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM
 (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b2)) AS codebooks_sha256 FROM r""")
def op12_vector_codes(spark, d):
    coded, book = codes.compress(table(spark, d, "embeddings"))
    return codes.with_label_errors(coded).select(
        "vec_id", codes.hex_code("code").alias("code"), "error", "label_error",
        F.lit(codes.digest(book)).alias("codebooks_sha256"))


CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''),
 lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, e: CASE WHEN e >= 0
 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


@query("op13_prefix_trie", f"""WITH t AS (SELECT conv_id AS c, md5(octet_length(encode(coalesce(role,
 '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
 octet_length(encode(coalesce(text, ''))) AS b, row_number() OVER (PARTITION BY conv_id
 ORDER BY turn NULLS FIRST, coalesce(role, ''), m) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, count(*) AS n, {CRC32} % 9 AS h, c - c % 5 AS f FROM t GROUP BY c),
w AS (SELECT h.c, t.i, m, b FROM h JOIN t ON t.c = h.f AND t.i <= h.h UNION ALL
 SELECT h.c, t.i - h.h + least(h.h, coalesce(g.n, 0)), m, b
 FROM h JOIN t ON t.c = h.c AND t.i > h.h LEFT JOIN h g ON g.c = h.f),
p AS (SELECT c, i, b, list(m) OVER (PARTITION BY c ORDER BY i) AS k FROM w),
n AS (SELECT i AS depth, k, min(c) AS o, count(*) AS n, min(b) AS b FROM p GROUP BY i, k),
r AS (SELECT p.c, p.i, n.o FROM p JOIN n ON n.k = p.k
 UNION ALL SELECT c, 0, (SELECT min(c) FROM h) FROM h),
a AS (SELECT o, depth, n, b FROM n UNION ALL SELECT min(c), 0, count(*), 0 FROM h HAVING count(*) > 0),
u AS (SELECT a.o, a.depth, r.o AS parent FROM a JOIN r ON r.c = a.o AND r.i = a.depth - 1),
kids AS (SELECT parent AS o, depth - 1 AS depth, count(*) AS kids FROM u GROUP BY ALL),
s AS (SELECT r.o, r.i AS depth, count(*) FILTER (kids IS NULL) AS leaves,
 sum((a.n - 1) * a.b) AS saved FROM a LEFT JOIN kids USING (o, depth)
 JOIN r ON r.c = a.o AND r.i <= a.depth GROUP BY ALL),
e AS (SELECT o, i AS depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends
 FROM (SELECT c, max(i) AS i FROM r GROUP BY c) JOIN r USING (c, i) GROUP BY ALL)
SELECT o AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs,
 coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
 coalesce(ends, sha256('')) AS ends_sha256 FROM a LEFT JOIN u USING (o, depth)
 LEFT JOIN kids USING (o, depth) JOIN s USING (o, depth) LEFT JOIN e USING (o, depth)""")
def op13_prefix_trie(spark, d):
    turns, convs = trie.with_shared_openings(trie.numbered(table(spark, d, "conversations")))
    return trie.prefix_trie(turns, convs)
