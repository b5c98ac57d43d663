"""Queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_text, jaccard, lexical_search, line_dedup, mixing, packing, quality_rules, secret_scan, token_alignment, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Entries of three dated lists; the hosts are made up.
LIST_LOG = [
    ("adult", "cheap-pills.example.com", "2024-01-15", "add"),
    ("adult", "cheap-pills.example.com", "2024-06-01", "remove"),
    ("adult", "cheap-pills.example.com", "2024-09-01", "add"),
    ("ads", "ads-track.example.org", "2024-02-01", "add"),
    ("ads", "tionsh.example.net", "2024-03-10", "add"),
    ("ads", "tionsh.example.net", "2024-03-10", "remove"),
    ("ads", "tionsh.example.net", "2024-05-01", "add"),
    ("ads", "tionsh.example.net", "2024-05-20", "remove"),
    ("spam", "example.com", "2024-11-01", "add"),
    ("spam", "example.com", "2024-12-01", "remove"),
    ("spam", "m.ththth.example.net/en", "2024-04-01", "add"),
    ("spam", "blog.tionble.example.com/fr/10", "2024-01-01", "add"),
]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch day, which the table lacks: one of 2024, by the page's number."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.createDataFrame(LIST_LOG, "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    return url_filter.filter_urls(captures(spark, sf_dir), log)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def host_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the host of a page's address, over the lines of raw pages."""
    pages = table(spark, sf_dir, "pages")
    kept = line_dedup.drop_boilerplate(pages, "html", url_filter.host(F.col("url")))
    return kept.select("page_id", "n_lines", "n_dropped", F.sha2("html", 256).alias("html_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def _secret_sql() -> str:
    """Every rule's matches, and their places by the lengths of what lies before them."""
    kinds = []
    for rank, r in enumerate(secret_scan.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        kinds.append(f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, {str(r.base).lower()} AS base, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {r.group}) AS parts, string_split_regex(t, {p}) AS gaps FROM d")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({' UNION ALL '.join(kinds)}),
        e AS (SELECT doc_id, kind, rank, base, hits, gaps, least, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
        s AS (
            SELECT doc_id, kind, rank, base, length(hits[i]) AS n,
                   list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
            FROM e WHERE length(parts[i]) >= least),
        w AS (SELECT *, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT)) AS shown FROM s)
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(shown, ',' ORDER BY start, rank) FILTER (WHERE base), '')) AS base_sha256,
               coalesce(string_agg(shown, ',' ORDER BY start, rank), '') AS spans
        FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id"""


#: Levels and sources that the SQL of the splitting tree spells out: up to 1,024 shards, 24 sources.
TREE_LEVELS, TREE_SOURCES = 6, 24


def _tree_sql() -> str:
    """The splitting tree, level by level and in each node source by source, as common table expressions.

    A draw is the first number, outwards from the mode, at which the summed
    probabilities exceed the uniform one.
    """
    steps = ["l0 AS (SELECT 1 AS level, 0 AS node, list(draws ORDER BY src) AS have, list(CAST(0 AS BIGINT) ORDER BY src) AS firsts FROM q)"]
    for k in range(TREE_LEVELS):
        steps.append(f"t{k}_0 AS (SELECT *, CAST(list_sum(have) AS BIGINT) AS remain, CAST(floor((list_sum(have) + node % 2) / 2) AS BIGINT) AS room, CAST([] AS BIGINT[]) AS took FROM l{k} WHERE level < (SELECT n FROM shards))")
        for i in range(TREE_SOURCES):
            steps.append(f"""t{k}_{i + 1} AS (
                WITH g AS (SELECT *, have[{i + 1}] AS good, remain - have[{i + 1}] AS bad, (CAST('0x' || substr(md5(concat_ws('|', '1:' || level, node, {i})), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS u FROM t{k}_{i} WHERE len(have) > {i}),
                m AS (SELECT *, greatest(0, room - bad) AS low, least(good, room) AS high, least(least(good, room), greatest(greatest(0, room - bad), (good + 1) * (room + 1) // (good + bad + 2))) AS mode FROM g),
                x AS (SELECT *, unnest(range(low, high + 1)) AS x FROM m),
                w AS (SELECT *, CASE WHEN x > mode THEN 2 * (x - mode) - 1 ELSE 2 * (mode - x) END AS o, exp(lgamma(good + 1) - lgamma(x + 1) - lgamma(good - x + 1) + lgamma(bad + 1) - lgamma(room - x + 1) - lgamma(bad - room + x + 1) - lgamma(good + bad + 1) + lgamma(room + 1) + lgamma(good + bad - room + 1)) AS p FROM x),
                c AS (SELECT *, sum(p) OVER (PARTITION BY node ORDER BY o) > u AS over FROM w),
                k AS (SELECT node, coalesce(min_by(x, o) FILTER (WHERE over), min_by(x, o)) AS k FROM c GROUP BY node)
                SELECT level, node, have, firsts, remain - good AS remain, room - k AS room, list_append(took, k) AS took FROM g JOIN k USING (node)
                UNION ALL SELECT * FROM t{k}_{i} WHERE len(have) <= {i})""")
        last = f"t{k}_{TREE_SOURCES}"
        steps.append(f"""l{k + 1} AS (
            SELECT level * 2 AS level, node * 2 AS node, took AS have, firsts FROM {last}
            UNION ALL SELECT level * 2, node * 2 + 1, list_transform(list_zip(have, took), lambda z: z[1] - z[2]), list_transform(list_zip(firsts, took), lambda z: z[1] + z[2]) FROM {last})""")
    leaves = " UNION ALL ".join(f"SELECT node AS shard, unnest(have) AS have, unnest(firsts) AS first, generate_subscripts(have, 1) AS src FROM l{k + 1} WHERE level = (SELECT n FROM shards)" for k in range(TREE_LEVELS))
    return ", ".join([*steps, f"leaf AS ({leaves})"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_text": op3_html_text,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "host_line_dedup": host_line_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
    "op11_toxicity": op11_toxicity,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5(concat_ws('|', '1', coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))))), 1, 15) AS BIGINT) AS pos
            FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
        weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
        filling AS (
            SELECT *, (sum(source_size) OVER () * 150 / 100.0 - coalesce(sum(source_size) OVER f, 0) * 2)
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
            FROM weighed
            WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        aimed AS (
            SELECT source, source_size, docs,
                   CASE WHEN source_size * 2 <= level * weight THEN CAST(source_size * 2 AS DOUBLE)
                        ELSE least(CAST(source_size * 2 AS DOUBLE), max(CASE WHEN source_size * 2 > level * weight THEN level END) OVER () * weight) END AS target
            FROM filling),
        s AS (
            SELECT source, source_size, target, greatest(1, ceil(source_size / 65536), ceil(docs / 4096)) AS blocks,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
            FROM aimed),
        b AS (
            SELECT d.*, s.source_size, s.target, s.passes, s.target - s.passes * s.source_size AS rest,
                   least(floor(CAST(d.pos AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE) * s.blocks), s.blocks - 1) AS block
            FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        filled AS (SELECT source, block, any_value(rest) AS rest, sum(size) AS words FROM b GROUP BY source, block),
        started AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM filled),
        last AS (SELECT source, block AS last_block, rest - start AS room FROM started WHERE start <= rest AND start + words > rest),
        queue AS (
            SELECT b.source, doc_id, size, room, row_number() OVER (PARTITION BY b.source ORDER BY pos, size) AS n
            FROM b JOIN last l ON b.source IS NOT DISTINCT FROM l.source AND b.block = l.last_block WHERE size > 0),
        walk AS (
            SELECT source, doc_id, n, size <= room AS fits, CASE WHEN size <= room THEN room - size ELSE room END AS room FROM queue WHERE n = 1
            UNION ALL
            SELECT q.source, q.doc_id, q.n, q.size <= w.room, CASE WHEN q.size <= w.room THEN w.room - q.size ELSE w.room END
            FROM walk w JOIN queue q ON q.source IS NOT DISTINCT FROM w.source AND q.n = w.n + 1),
        left_over AS (SELECT source, min(room) AS room FROM walk GROUP BY source),
        nearer AS (
            SELECT DISTINCT ON (q.source) q.source, q.doc_id FROM queue q JOIN left_over r ON q.source IS NOT DISTINCT FROM r.source
            JOIN walk w ON w.source IS NOT DISTINCT FROM q.source AND w.doc_id = q.doc_id AND NOT w.fits
            WHERE q.size < 2 * r.room ORDER BY q.source, q.size, q.n),
        extra AS (SELECT source, doc_id FROM walk WHERE fits UNION ALL SELECT source, doc_id FROM nearer),
        q AS (
            SELECT row_number() OVER (ORDER BY s.source NULLS LAST) AS src, s.source, CAST(s.blocks AS BIGINT) AS blocks, CAST(s.passes AS BIGINT) AS passes, CAST(l.last_block AS BIGINT) AS last_block,
                   CAST(s.passes * s.blocks + coalesce(l.last_block + 1, 0) AS BIGINT) AS draws
            FROM s LEFT JOIN last l ON s.source IS NOT DISTINCT FROM l.source),
        shards AS (SELECT min(16 * CAST(pow(2, k) AS BIGINT)) AS n FROM range(7) r(k) WHERE 16 * pow(2, k) * 4194304 >= (SELECT sum(target) FROM s)),
        """ + _tree_sql() + r""",
        place AS (SELECT src, shard, unnest(range(first, first + have)) AS place FROM leaf),
        dealt AS (SELECT q.source, shard, place * 2147483647 % draws AS draw, blocks, passes, last_block FROM place JOIN q USING (src)),
        draw AS (SELECT source, shard, draw % blocks AS block, draw // blocks AS pass, coalesce(draw = passes * blocks + last_block, false) AS ends FROM dealt),
        mine AS (
            SELECT b.doc_id, string_agg(shard, ',' ORDER BY pass) AS shards
            FROM b JOIN draw ON b.source IS NOT DISTINCT FROM draw.source AND b.block = draw.block
            WHERE NOT ends OR EXISTS (SELECT 1 FROM extra w WHERE w.doc_id = b.doc_id AND w.source IS NOT DISTINCT FROM b.source)
            GROUP BY b.doc_id)
        SELECT b.doc_id, b.size, b.source_size, b.target,
               CAST(b.size * (b.passes + CASE WHEN b.block < l.last_block OR w.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken, coalesce(mine.shards, '') AS shards
        FROM b LEFT JOIN last l ON b.source IS NOT DISTINCT FROM l.source
        LEFT JOIN extra w ON w.doc_id = b.doc_id AND w.source IS NOT DISTINCT FROM b.source
        LEFT JOIN mine ON mine.doc_id = b.doc_id""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op4_url_filter": f"""
        WITH log AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in LIST_LOG)}) AS v(list, key, day, action)),
        daily AS (SELECT list, key, day, max(CAST(action <> 'add' AS INT)) AS off FROM log GROUP BY ALL),
        turned AS (SELECT *, coalesce(lag(off) OVER (PARTITION BY list, key ORDER BY day), 1) AS was FROM daily),
        turns AS (SELECT * FROM turned WHERE was <> off),
        spans AS (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM turns),
        active AS (SELECT list, key, day AS since, until FROM spans WHERE off = 0),
        c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched,
                     regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]$', '') AS host,
                     regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        hits AS (
            SELECT page_id, list FROM c JOIN active a ON fetched >= since AND (until IS NULL OR fetched < until)
            AND (CASE WHEN contains(key, '/') THEN host = split_part(key, '/', 1) AND (path || '/') LIKE (substr(key, length(split_part(key, '/', 1)) + 1) || '/%')
                 ELSE host = key OR host LIKE '%.' || key END)),
        n AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id)
        SELECT page_id AS id, url, fetched, n.n IS NULL AS allowed, coalesce(n.n, 0) AS n_matches, coalesce(lists, '') AS lists FROM c LEFT JOIN n USING (page_id)""",
    "op6_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        p AS (SELECT *, row_number() OVER w AS place, string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id FROM p WHERE place = n_turns GROUP BY prefix, n_turns),
        kept AS (SELECT conv_id, n_turns FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.prefix = w.prefix))
        SELECT p.conv_id, (place - 1) // 256 AS part, kept.n_turns, string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' ORDER BY place) AS text
        FROM p JOIN kept USING (conv_id) GROUP BY 1, 2, 3""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS inked FROM l),
        c AS (SELECT source, inked, count(DISTINCT doc_id) AS pages FROM k WHERE inked <> '' GROUP BY ALL),
        t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        b AS (SELECT c.source, inked FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 5 AND pages > total * CAST(0.02 AS DOUBLE)),
        m AS (SELECT k.*, b.inked IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.inked = b.inked)
        SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
        FROM m GROUP BY doc_id, source""",
    "host_line_dedup": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]$', ''), '') AS host FROM pages),
        l AS (SELECT page_id, host, generate_subscripts(string_split(html, chr(10)), 1) AS i, unnest(string_split(html, chr(10))) AS line FROM p),
        k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS inked FROM l),
        c AS (SELECT host, inked, count(DISTINCT page_id) AS pages FROM k WHERE inked <> '' GROUP BY ALL),
        t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
        b AS (SELECT c.host, inked FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE pages >= 5 AND pages > total * CAST(0.02 AS DOUBLE)),
        m AS (SELECT k.*, b.inked IS NOT NULL AS gone FROM k LEFT JOIN b ON k.host IS NOT DISTINCT FROM b.host AND k.inked = b.inked)
        SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS html_sha256
        FROM m GROUP BY page_id""",
    "op9_secret_scan": _secret_sql(),
    "op12_lexical_search": r"""
        WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS little, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
        d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, little), term) AS words FROM documents, fold),
        n AS (SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        p AS (SELECT row, word, count(*) AS tf FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
        w AS (SELECT word, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, whole GROUP BY word, docs),
        q AS (SELECT item_id, word, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), big, little), term)) AS word FROM benchmark, fold) GROUP BY ALL),
        s AS (
            SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN w USING (word) JOIN p USING (word) JOIN n USING (row), whole GROUP BY item_id, doc_id, row),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
