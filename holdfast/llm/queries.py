"""The operators' queries over the synthetic tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch, read
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .lexical_search import ranked
from .line_dedup import duplicate_lines
from .minhash import near_duplicates
from .mixing import mix
from .secret_scan import generated_findings, sampled_findings, scan_secrets, train
from .spelling import variants
from .token_output import token_digests, write_tokens
from .topk_search import top_k
from .toxicity import toxicity
from .url_filter import HOST_RULES, METHOD_RULES, filter_urls
from .warc import derivatives, responses


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_blocks")


def op2_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80).drop("group", "text_key")


def op3_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    used = mix(docs, budget=1.0, entropy_gain=0.5, max_repeats=4.0)
    return used.select("row.doc_id", "row.source", "epoch", "block", "n_tokens", "weight")


def op4_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return scan_secrets(docs, train(generated_findings() + sampled_findings(docs), recall=0.98))


def op5_url_filter(spark, sf_dir):
    judged = filter_urls(read(spark, sf_dir, "pages"), HOST_RULES + METHOD_RULES)
    contract = F.col("tier") == 0  # only host rules are named; the method's show in the verdict
    return judged.select("page_id", "host", "path", F.when(contract, F.col("rule")).alias("rule"), "verdict")


def op6_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    return duplicate_lines(read(spark, sf_dir, "documents"), percent=80)


def op8_decontaminate(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def encoded(spark, docs, tokenizer="word_bpe_49k.json"):
    """Writes the texts' ids to a folder of their own in the shared root and reads the files back."""
    import public_tokenizers

    folder = Scratch(spark, "token-output").base
    write_tokens(docs, folder, public_tokenizers.path(tokenizer))
    return token_digests(spark, folder)


def op10_token_output(spark, sf_dir):
    return encoded(spark, read(spark, sf_dir, "documents"))


#: The pages table has no crawl date; a fixed one keeps record ids and digests the same for every run.
CRAWL_DATE = "2024-01-01T00:00:00Z"


def op9_warc(spark, sf_dir):
    return derivatives(responses(read(spark, sf_dir, "pages"), CRAWL_DATE))


def op11_lexical_search(spark, sf_dir):
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_spelling_variants(spark, sf_dir):
    return variants(read(spark, sf_dir, "documents"))


def op13_topk_search(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_minhash": op2_minhash,
    "op3_mixing": op3_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_token_output": op10_token_output,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_topk_search": op13_topk_search,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_HOST_SQL = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
    for h, _, p in (r.name.partition("/") for r in sorted(HOST_RULES, key=lambda r: -len(r.name)))
)
_RULE_VERDICT_SQL = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
_METHOD_SQL = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in METHOD_RULES)

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_exact_dedup": f"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents)""",
    "op5_url_filter": f"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             r AS (SELECT *, CASE {_HOST_SQL} END AS rule FROM u)
        SELECT page_id, host, path, rule,
               CASE {_RULE_VERDICT_SQL} WHEN {_METHOD_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op11_lexical_search": rf"""
        WITH t AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
             tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
             d AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
             s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
             w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
             q AS (SELECT i, item_id, unnest(list_distinct({_TERMS})) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
             scored AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
                               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
                        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY i, r),
             placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
        SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= 10""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
             r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
             l AS (SELECT doc_id, w, count(*) AS n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: unicode(x)) AS points FROM r WHERE length(w) >= 7 GROUP BY doc_id, w),
             b AS (SELECT w, n, list_prepend(4294967295::BIGINT, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p::BIGINT] ELSE [195::BIGINT, p - 64] END))) AS bytes FROM l),
             h AS (SELECT w, n, xor(list_reduce(bytes, lambda s, x: xor(crc[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) AS h FROM b, c),
             t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
             v AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
             d AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM v)),
             near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b USING (rest, p) WHERE a.word <> b.word
                      UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.rest UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.rest),
             best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
             named AS (SELECT word, n_near, best_n, min(other) AS best FROM best JOIN near USING (word) WHERE other_n = best_n GROUP BY ALL),
             f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN named USING (word)),
             chain AS (SELECT word, form, coalesce(form, word) AS root FROM f UNION ALL SELECT c.word, f.form, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL AND c.form IS NOT NULL)
        SELECT f.word, f.form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, n) AS root FROM (SELECT c.word, root, v.n FROM chain c JOIN v ON v.word = c.root) GROUP BY word) USING (word)""",
    "op13_topk_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
             o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, place::INT AS rank, vec_id, score FROM o WHERE place <= 5""",
}
