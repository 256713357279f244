"""The operators as named queries over whole tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import alignment, collocations, decontam, embedding_dedup, exact_dedup, jaccard, licenses, packing, pseudo_likelihood, quality, suffix_dedup, token_orc, url_filter
from tarnflow.llm.shared import table
from tarnflow.llm.tokens import tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"), longest=1500, above=2)  # the limits that the query's SQL sets
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.size("findings").cast("long").alias("n_findings"), "n_sentences")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenise_to_orc(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_token_orc, op4_exact_dedup, op5_url_filter, op6_decontamination, op7_pseudo_likelihood, op8_suffix_dedup, op9_jaccard_join, op10_quality_classifier, op11_collocations, op12_embedding_dedup, op13_alignment)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NUMBER = {name: str(i) for i, name in enumerate(licenses.SENTENCES, 1)}
_RUNS = sorted({",".join(_NUMBER[s] for s in run): name for name, run in licenses.RULES}.items(), key=lambda r: (-r[0].count(","), r[0]))


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""
        WITH known(body, n) AS (
            VALUES {', '.join(f"('{licenses.plain(text)}', '{_NUMBER[name]}')" for name, text in licenses.SENTENCES.items())}
        ), rules(run, licence) AS (
            VALUES {', '.join(str(r) for r in _RUNS)}
        ), texts AS (
            SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'Identifier:', 'Identifier '), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents
        ), cut AS (
            SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '\\n[ \\t]*\\n', chr(1), 'g'), '[.!?;:]+\\s+', chr(1), 'g'), chr(1)) AS p FROM texts
        ), parts AS (
            SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM cut
        ), below AS (
            SELECT *, CASE WHEN contains(part, chr(10)) THEN substr(part, strpos(part, chr(10)) + 1) END AS b FROM parts
        ), named AS (
            SELECT doc_id, i, part, k.n AS whole, coalesce(k1.n, k2.n) AS under FROM below
            LEFT JOIN known k ON length(part) <= 1500 AND k.body = {_normal("part")}
            LEFT JOIN known k1 ON length(part) <= 1500 AND k1.body = {_normal("b")}
            LEFT JOIN known k2 ON length(part) <= 1500 AND k2.body = {_normal("CASE WHEN contains(b, chr(10)) THEN substr(b, strpos(b, chr(10)) + 1) ELSE b END")}
        ), lines AS (
            SELECT doc_id, i, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS j
            FROM named WHERE whole IS NULL AND under IS NULL
        ), each_ AS (
            SELECT doc_id, i, 1 AS j, whole AS n FROM named WHERE whole IS NOT NULL
            UNION ALL SELECT doc_id, i, 0, 'x' FROM named WHERE whole IS NULL AND under IS NOT NULL
            UNION ALL SELECT doc_id, i, 1, under FROM named WHERE whole IS NULL AND under IS NOT NULL
            UNION ALL SELECT doc_id, i, j, coalesce(n, 'x') FROM lines LEFT JOIN known ON body = {_normal("line")} WHERE length({_normal("line")}) > 2
        ), ids AS (
            SELECT doc_id, string_agg(n, ',' ORDER BY i, j) AS ids, count(*) FILTER (n <> 'x') AS known_ones FROM each_ GROUP BY doc_id
        ), found AS (
            SELECT doc_id, replace(unnest(regexp_extract_all(ids, '\\b({'|'.join(r.replace(",", "(?:,x){0,2},") for r, _ in _RUNS)})\\b', 1)), ',x', '') AS run FROM ids
        ), findings AS (
            SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n FROM found JOIN rules USING (run) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(f.n, 0) AS n_findings, coalesce(known_ones, 0) AS n_sentences
        FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN findings f ON d.doc_id = f.doc_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        WINDOW same AS (PARTITION BY body)
    """,
    "op5_url_filter": f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), rules(verdict, h, p) AS (
            VALUES {', '.join(str(r) for r in url_filter.RULES)}
        ), fits AS (
            SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS nth
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE nth = 1) AS best ON parts.page_id = best.page_id
    """,
    "op6_decontamination": f"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
        ), sized AS (
            SELECT item_id, w, least(10, len(w)) AS t FROM items WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, t, array_to_string(w[i:i + t - 1], ' ') AS body
            FROM (SELECT item_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM sized)
        ), places AS (
            SELECT doc_id, t, i, array_to_string(w[i:i + t - 1], ' ') AS body
            FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM docs, (SELECT DISTINCT t FROM sized) WHERE len(w) >= t)
        ), found AS (
            SELECT doc_id, i, places.t, item_id FROM places JOIN windows ON places.body = windows.body AND places.t = windows.t
        ), hit AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS j FROM (SELECT DISTINCT doc_id, i, t FROM found)) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
        )
        SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN named ON docs.doc_id = named.doc_id
    """,
    "op8_suffix_dedup": f"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS body FROM docs, unnest(range(1, len(w) - 48)) AS places(i)
        ), shared AS (
            SELECT body, min(doc_id) AS least, list_sort(list_distinct(list(doc_id)))[2] AS second FROM windows GROUP BY body HAVING min(doc_id) <> max(doc_id)
        ), hits AS (
            SELECT doc_id, i, CASE WHEN doc_id = least THEN second ELSE least END AS partner FROM windows JOIN shared USING (body)
        ), marked AS (
            SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits
        ), islands AS (
            SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked
        )
        SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, max(i) + 50 - min(i) AS n_words, min(partner) AS partner_id, min(partner) < doc_id AS is_later
        FROM islands GROUP BY doc_id, island
    """,
    "op9_jaccard_join": f"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\x09-\\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM docs
            UNION
            SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
        )
        SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM docs LEFT JOIN sizes ON docs.doc_id = sizes.doc_id
        JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r ON docs.doc_id = r.doc_id
    """,
    "op11_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
        ), counts AS (
            SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE len(w) >= size)
            GROUP BY ALL HAVING count(*) >= 30
        ), several AS (
            SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE size > 1
        ), cuts AS (
            SELECT s.lang, s.phrase, a, k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM several) s
            JOIN counts l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:k], ' ')
            JOIN counts r ON r.lang = s.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_ AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM several WHERE size > 2)) GROUP BY ALL
        ), kept AS (
            SELECT best.* FROM best LEFT JOIN inner_ ON best.lang = inner_.lang AND best.phrase = inner_.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op12_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER () AS nth FROM embeddings
        ), good AS (
            SELECT * FROM vectors WHERE len(v) > 0 AND list_aggregate(list_transform(v, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0 AND list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0 AND vec_id IS NOT NULL
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.nth FROM good a JOIN good b ON a.nth <> b.nth AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reached(vec_id, other) AS (
            SELECT vec_id, vec_id FROM vectors UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a
        ), counts AS (
            SELECT nth, count(*) AS n FROM links GROUP BY nth
        )
        SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
        FROM vectors v LEFT JOIN counts ON v.nth = counts.nth JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) r ON v.vec_id = r.vec_id
    """,
}
