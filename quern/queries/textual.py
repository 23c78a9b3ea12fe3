"""Text, URL and identifier functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, text, web
from ..operators import distill, keyword, rawsearch
from ..sources.readers import cards, parse_cards, parse_pages
from .model import RAW, concepts, raw_documents, table
from .registry import query

W = r"[\p{L}\p{N}_]+"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{W}')) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '{W}'), ' ')) AS digest FROM documents")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents),
b AS (SELECT word, regexp_extract_all(hex(encode(word)), '..') AS h FROM w)
SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(h, lambda x: ('0x' || x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS hash FROM b""")
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.word_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", embed.fnv1a(F.col("word")).alias("hash"))


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS t FROM documents),
g AS (
  SELECT doc_id, unnest(t) AS g, unnest(list_transform(range(len(t)), lambda i: 1.0::DOUBLE + 0.5::DOUBLE * greatest(0, 10 - i) / 10)) AS w FROM t
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), unnest(list_transform(range(len(t) - 1), lambda i: 1.2::DOUBLE * (1.0::DOUBLE + 0.5::DOUBLE * greatest(0, 10 - i) / 10))) FROM t
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))), 0.4::DOUBLE FROM (SELECT doc_id, unnest(t) AS w FROM t) WHERE length(w) >= 3),
s AS (SELECT doc_id, g, sum(w) AS w FROM g GROUP BY doc_id, g),
h AS (SELECT g, list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 384 AS bucket FROM (SELECT DISTINCT g FROM s)),
b AS (SELECT doc_id, bucket::INT AS bucket, sum(w) AS w FROM s JOIN h USING (g) GROUP BY doc_id, bucket)
SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def hash_embed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.hash_embedding_buckets(docs, "doc_id", "text", unit=True).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(r"""SELECT page_id, CASE WHEN length(slug) BETWEEN 1 AND 29 THEN slug || '_' || left(d, 8) ELSE 'doc_' || left(d, 16) END AS id FROM (
SELECT page_id, sha256(url || ':' || left(html, 500)) AS d, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '^.*/', ''), '(.)\.[^.]*$', '\1')), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages)""")
def doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.document_id(F.col("url"), F.col("html")).alias("id"))


@query("SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM documents")
def highlight_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences(F.lower("text"), F.lit("the")).alias("hits"))


@query(rf"SELECT doc_id, len(b) AS n_bigrams, md5(array_to_string(b, ' ')) AS digest FROM (SELECT doc_id, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS t FROM documents))")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", text.bigrams(text.word_tokens(F.col("text"))).alias("b"))
    return b.select("doc_id", F.size("b").cast("long").alias("n_bigrams"), F.md5(F.array_join("b", " ").cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, round(sum(w), 6) AS weight FROM (SELECT doc_id, unnest(list_transform(range(len(t)), lambda i: 1.0::DOUBLE + 0.5::DOUBLE * greatest(0, 10 - i) / 10)) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS t FROM documents)) GROUP BY doc_id")
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_tokens(F.col("text"))).alias("i", "t"))
    return t.groupBy("doc_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), (F.lit(10) - F.col("i")) / 10.0) * 0.5 + 1.0), 6).alias("weight"))


_STOP = ", ".join(f"'{w}'" for w in (*text.GRAPH_STOP_WORDS, "auto_extracted"))
_GRAPH_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9가-힣]{{3,}}'), lambda x: x NOT IN ({_STOP}))))"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_GRAPH_TOKENS} AS t FROM documents)")
def graph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.sort_array(text.graph_tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: w <> ''), ' ') AS words FROM documents")
def sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.sanitize_query(F.col("text")), " ").alias("words"))


@query(f"WITH {RAW} " + r"""SELECT id, 5 * contains(lower(title), 'the')::INT + (length(content) - length(replace(lower(content), 'the', ''))) // 3 AS match_count,
CASE WHEN at = 0 THEN title ELSE (CASE WHEN s > 1 THEN '...' ELSE '' END) || replace(substring(content, s, e - s), chr(10), ' ') || (CASE WHEN e <= length(content) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, greatest(at - 60, 1) AS s, least(at + 3 + 90, length(content) + 1) AS e FROM (SELECT *, instr(lower(content), 'the') AS at FROM raw))
WHERE contains(lower(title), 'the') OR at > 0 ORDER BY match_count DESC, id LIMIT 20""".replace(" at ", " hit ").replace("(at ", "(hit ").replace("N at", "N hit"))
def raw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawsearch.raw_search(raw_documents(spark, sf_dir), "the", 20).select("id", "match_count", "snippet")


@query(f"WITH {RAW} " + r"""SELECT id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || replace(substring(content, s, e - s), chr(10), ' ') || (CASE WHEN e <= length(content) THEN '...' ELSE '' END) AS snippet
FROM (SELECT *, greatest(hit - 60, 1) AS s, least(hit + 2 + 90, length(content) + 1) AS e FROM (SELECT *, instr(lower(content), 'en') AS hit FROM raw)) WHERE hit > 0""")
def raw_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_documents(spark, sf_dir).withColumn("snippet", text.snippet(F.col("content"), F.lit("en")))
    return r.where("snippet != ''").select("id", "snippet")


@query(f"WITH {RAW} SELECT id, 5 * contains(lower(title), 'and')::INT + (length(content) - length(replace(lower(content), 'and', ''))) // 3 AS match_count FROM raw WHERE contains(lower(content), 'and') OR contains(lower(title), 'and')")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawsearch.raw_matches(raw_documents(spark, sf_dir), "and").select("id", "match_count")


@query(f"""WITH {RAW} SELECT 'raw:' || id AS concept_id, round(0.55::DOUBLE + least(0.35::DOUBLE, 0.02::DOUBLE * n), 4) AS score, 'matches:' || n AS tag FROM
(SELECT id, 5 * contains(lower(title), 'of')::INT + (length(content) - length(replace(lower(content), 'of', ''))) // 2 AS n FROM raw) WHERE n > 0""")
def raw_hit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rawsearch.as_hits(rawsearch.raw_matches(raw_documents(spark, sf_dir), "of"))
    return hits.select("concept_id", "score", F.col("tags")[1].alias("tag"))


_CANON = r"""lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]+)', 1)) || coalesce(CASE WHEN regexp_extract(url, '://[^/?#:]+(:\d+)', 1) IN (':80', ':443') THEN '' ELSE regexp_extract(url, '://[^/?#:]+(:\d+)', 1) END, '')
|| CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '') END || regexp_extract(url, '(\?[^#]+)', 1)"""


@query(f"SELECT page_id, {_CANON} AS url FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
a AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href AS target FROM l WHERE starts_with(href, '/'))
SELECT page_id, count(*) AS links, count(*) FILTER (NOT regexp_matches(target, '(?i)\.(png|jpe?g|gif|webp|svg|ico|pdf|zip|7z|rar|mp[34]|wav|ogg|webm|woff2?|ttf|css|js)$')) AS crawlable FROM a GROUP BY page_id""")
def crawlable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    links = links.withColumn("target", web.resolve_link(F.col("url"), F.col("href"))).where("target IS NOT NULL")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(web.is_crawlable(F.col("url"), F.col("target"))).alias("crawlable"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS o, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
e AS (SELECT o || unnest(h) AS url, trim(unnest(t)) AS anchor FROM l)
SELECT url, arg_max(anchor, (length(anchor), anchor)) AS anchor, count(*) AS n FROM e GROUP BY url""")
def link_best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("h"), F.regexp_extract_all("html", pattern, 2).alias("t"))
    links = p.select("url", F.explode(both).alias("x")).select(web.resolve_link(F.col("url"), F.col("x")["h"]).alias("url"), F.trim(F.col("x")["t"]).alias("anchor"))
    return links.groupBy("url").agg(F.max_by("anchor", F.struct(F.length("anchor"), F.col("anchor"))).alias("anchor"), F.count("*").alias("n"))


_NOISE = " OR ".join(f"contains(trim(x), '{n}')" for n in text.NOISE_LINES)
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\[include\([^\)]+\)\]', '', 'g'), '\{\{[^\}]+\}\}', '', 'g'), '\[\[분류:[^\]]+\]\]', '', 'g'), '\[\*[^\]]*\]', '', 'g'), '\[\d+\]', '', 'g')"


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split({_STRIPPED}, chr(10)), lambda x: NOT (({_NOISE}) AND length(trim(x)) < 30)), chr(10))) AS digest FROM documents")
def web_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_web_noise(F.col("text")).cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', E'\n\n', 'g')) AS s FROM documents)""")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", text.squeeze_lines(F.col("text")).alias("s"))
    return s.select("doc_id", F.char_length("s").cast("long").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query(r"""SELECT page_id, title, trim(regexp_replace(title, '(?i)\s*[-—|:]\s*(나무위키|위키백과|Wikipedia|velog|GitHub|tistory|블로그|Blog|뉴스|News).*$', '')) AS clean
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || (CASE WHEN page_id % 3 = 0 THEN ' - Wikipedia' WHEN page_id % 3 = 1 THEN ' | Blog of all' ELSE '' END) AS title FROM pages)""")
def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("page_id") % 3 == 0, " - Wikipedia").when(F.col("page_id") % 3 == 1, " | Blog of all").otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), end).alias("title"))
    return p.select("page_id", "title", text.strip_title_suffix(F.col("title")).alias("clean"))


@query(r"""WITH p AS (SELECT p_partkey, p_name AS a, p_type AS b, regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', '', 'g') AS x, regexp_replace(lower(split_part(p_name, ' ', 1) || '-' || p_brand), '[^\p{L}\p{N}_]+', '', 'g') AS y,
regexp_replace(lower(split_part(p_name, ' ', 1)), '[^\p{L}\p{N}_]+', '', 'g') AS z FROM part)
SELECT p_partkey, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS with_brand, x <> '' AND z <> '' AND (contains(x, z) OR contains(z, x)) AS with_first FROM p""")
def name_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index("p_name", " ", 1)
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.names_compatible(F.col("p_name"), F.concat(first, F.lit("-"), F.col("p_brand"))).alias("with_brand"), text.names_compatible(F.col("p_name"), first).alias("with_first"))


_RAW_ANSWER = """CASE event_id % 3 WHEN 0 THEN 'Sure: [' || props || '] done' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE 'none ' || event_type END"""


@query(rf"""SELECT event_id, CASE WHEN regexp_matches(t, '(?s)\[.*\]') THEN regexp_extract(t, '(?s)\[.*\]') WHEN regexp_matches(t, '(?s)\{{.*\}}') THEN '[' || regexp_extract(t, '(?s)\{{.*\}}') || ']' ELSE t END AS found
FROM (SELECT event_id, trim(regexp_replace(regexp_replace(trim({_RAW_ANSWER}), '^```[^\n]*\n', ''), '\n```$', '')) AS t FROM events)""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("Sure: ["), "props", F.lit("] done"))).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("none "), "event_type"))
    return e.select("event_id", text.json_salvage(raw).alias("found"))


@query(rf"""WITH h AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?:''''''|\*\*)([가-힣a-zA-Z0-9_\- ]{{2,30}})(?:''''''|\*\*)', 1), lambda x: {{'n': trim(x), 's': 4}}) || list_transform(regexp_extract_all(text, '[「『"]([가-힣a-zA-Z0-9_\- ]{{2,25}})[」』"]', 1), lambda x: {{'n': trim(x), 's': 3}})
|| list_transform(regexp_extract_all(text, '\n#{{1,4}}\s*(?:\d+[\.\s]+)*([가-힣a-zA-Z0-9_\- ]{{2,30}})', 1), lambda x: {{'n': trim(regexp_replace(trim(x), '^(?:{text.HEADING_WORDS})\s*', '')), 's': 5}}) || list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][a-z]{{2,12}} [A-Z][a-z]{{2,12}})(?:$|[^A-Za-z])', 1), lambda x: {{'n': trim(x), 's': 1}})) AS x FROM documents)
SELECT doc_id, x.n AS name, sum(x.s)::BIGINT AS score FROM h WHERE length(x.n) BETWEEN 2 AND 25 AND NOT regexp_matches(x.n, '^[0-9]+$') AND x.n NOT IN ({", ".join(f"'{w}'" for w in text.ENTITY_STOP_WORDS)}) GROUP BY doc_id, x.n""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.entity_hits(F.col("text"), capitalised=True)).alias("x"))
    return hits.groupBy("doc_id", "x.name").agg(F.sum("x.score").alias("score"))


@query(r"""SELECT doc_id, word, left(trim(replace(regexp_extract(text, '([^.?!;\n]*?' || word || '[^.?!;\n]*[.?!;\n])', 1), chr(10), ' ')), 250) AS context FROM (SELECT doc_id, text, regexp_extract(text, '(?:^|[^\p{L}])([a-zA-Z]{6,})(?:$|[^\p{L}])', 1) AS word FROM documents)
WHERE word <> '' AND regexp_matches(text, '[^.?!;\n]*?' || word || '[^.?!;\n]*[.?!;\n]')""")
def representative_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"(?:^|[^\p{L}])([a-zA-Z]{6,})(?:$|[^\p{L}])", 1).alias("word")).where("word != ''")
    found = d.where(text.sentence_with(F.col("text"), F.col("word")).isNotNull())
    return found.select("doc_id", "word", text.representative_sentence(F.col("text"), F.col("word")).alias("context"))


@query(r"""SELECT 'doc_' || doc_id AS doc, regexp_replace(regexp_replace(lower(name), '[^a-zA-Z0-9가-힣]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, left(CASE WHEN len(l) > 1 THEN l[1] || ' ' || l[2] ELSE l[1] END, 300) AS summary, len(l) AS n_lines
FROM (SELECT doc_id, trim(left(text, 40)) AS name, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(regexp_replace(trim(x), '^#+\s*', ''))), lambda x: length(x) >= 8 AND NOT regexp_matches(x, '^[0-9]+\s*$')) AS l FROM documents)""")
def heuristic_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_documents(spark, sf_dir).select("id", F.trim("title").alias("name"), distill.meaningful_lines(F.col("content")).alias("l"))
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    return d.select(F.col("id").alias("doc"), text.concept_slug(F.col("name")).alias("slug"), F.left(F.when(F.size("l") > 1, F.concat_ws(" ", first, second)).otherwise(first), F.lit(300)).alias("summary"), F.size("l").cast("long").alias("n_lines"))


@query()
def heuristic_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_documents(spark, sf_dir).withColumn("created_at", F.lit("2026-01-01"))
    return distill.heuristic_concepts(docs).select("id", "name", "type", "summary", F.size("relations").alias("n_relations"), F.size("mechanisms").alias("n_mechanisms"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distill.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return d.select("doc_id", "chunk", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(table(spark, sf_dir, "pages")).select("source", "title", "text")


@query()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and headings in each page's readable part; menus are none of it."""
    p = parse_pages(table(spark, sf_dir, "pages"))
    return p.select("source", F.size("links").alias("n_links"), F.regexp_count("text", F.lit(r"(?m)^#{1,4} ")).alias("n_headings"))


@query()
def markdown_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_documents(spark, sf_dir).withColumn("created_at", F.lit("2026-01-01"))
    made = distill.heuristic_concepts(docs)
    back = parse_cards(cards(made)).select("id", F.col("name").alias("name_back"), F.size("relations").alias("n_back"))
    return back.groupBy("id").agg(F.count("*").alias("cards"), F.sum("n_back").alias("relations"))


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"name": 5.0, "tags": 2.0, "summary": 1.0, "body": 1.0}
    tokens = keyword.tokenized(concepts(spark, sf_dir), "id", list(fields), stem=True)
    found = keyword.bm25(tokens, "id", "thing and ending", fields, stem=True)
    return found.select("id", F.round("score", 6).alias("score"))
