"""Extraction: names, typed relations and facts of every chunk, by column expressions inside the chunk's row.

Rows are exploded with `explode_outer`: `explode` would let the optimizer infer a filter on the array and push it, and with
it every expression the array is made of, down to the scan, to be evaluated once more.

No shuffle: names are counted by sorting a chunk's matches, the eight most frequent stay, pairs of these are exploded with
the chunk's sentences only as far as relations need them. Lists are linear in a chunk's length but for the sort.

Defined results: null and empty texts give no names, relations or facts; a chunk without names has the first facts of any
sentence; repeated rows are the caller's to drop (see `segment.distinct_chunks`); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import lexicon as lx
from folioweave.functions.text import WS, W, defanged, redacted, reordered, scrubbed, sentences_abbreviated, strings, tabular, words
from folioweave.operators.segment import distinct_chunks
from folioweave.sources.tables import table

TOP = 8
FACTS = 6
FACT_CHARS = (20, 240)
LATIN = rf"(?<![{W}])[A-Z][a-zA-Z0-9]+(?:[{WS}]+[A-Z][a-zA-Z0-9]+){{0,3}}(?![{W}])"
BENGALI = rf"[ঀ-৿]+(?:[{WS}]+[ঀ-৿]+){{0,3}}"


def clean(text: Column) -> Column:
    """A chunk's text as names and sentences are read from it."""
    return reordered(defanged(scrubbed(text)))


def _without_head(name: Column) -> Column:
    """one leading determiner, honorific or stop word off, while something remains."""
    stop = strings(sorted(set(lx.STOPWORDS + lx.LEADING)))
    rest = F.regexp_extract(name, "^[^ ]+ (.+)$", 1)
    return F.when((rest != "") & F.array_contains(stop, F.substring_index(name, " ", 1)), rest).otherwise(name)


def valid(name: Column) -> Column:
    """No blob, address, number or dump."""
    one = F.instr(name, " ") == 0
    dump = one & (name.rlike("^[0-9A-Fa-f]{12,}$") | ((F.length(name) > 24) & ~name.rlike("[aeiouAEIOU]")))
    return name.isNotNull() & (F.length(name) <= 80) & (F.size(words(name)) <= 8) & ~name.contains("\n") & ~name.contains("://") & ~dump & name.rlike(r"\p{L}")


def only_stop_words(name: Column) -> Column:
    """P5: every word a stop word or, in any case, a survey's value."""
    return F.forall(F.split(name, " "), lambda t: t.isin(lx.STOPWORDS) | F.lower(t).isin(lx.VALUE_WORDS))


def latin_names(text: Column) -> Column:
    """Names in Latin letters, with repeats, in order."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(LATIN), F.lit(0)), lambda n: F.regexp_replace(n, f"[{WS}]+", " "))
    names = F.transform(F.transform(raw, _without_head), _without_head)
    return F.filter(names, lambda n: (F.length(n) >= 2) & valid(n) & ~n.rlike("^(?i)unnamed") & ~only_stop_words(n))


def bengali_names(text: Column) -> Column:
    """Bengali phrases of up to four words without numbers and without particles at their ends, with repeats, in order."""
    runs = F.regexp_extract_all(text, F.lit(BENGALI), F.lit(0))
    solid = F.transform(runs, lambda r: F.filter(words(r), lambda t: ~t.rlike(f"^[{lx.BENGALI_DIGITS}]+$")))
    stop = strings(lx.BENGALI_STOP)

    def inner(ts: Column) -> Column:
        kept = F.transform(ts, lambda t: ~F.array_contains(stop, t))
        first, last = F.array_position(kept, True).cast("int"), (F.size(ts) - F.array_position(F.reverse(kept), True) + 1).cast("int")
        return F.when(first > 0, F.array_join(F.slice(ts, first, last - first + 1), " "))

    return F.filter(F.transform(solid, inner), lambda n: F.length(n) >= 3)


def counted(sorted_names: Column) -> Column:
    """A1: (less, name) of every distinct one of an array that is sorted; `less` is minus its count."""
    n = F.size(sorted_names)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~F.element_at(sorted_names, i).eqNullSafe(F.get(sorted_names, i - F.lit(2))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n + 1))
    return F.when(n > 0, F.zip_with(starts, ends, lambda a, b: F.struct((a - b).alias("less"), F.element_at(sorted_names, a).alias("name")))).otherwise(F.array().cast("array<struct<less:int,name:string>>"))


def single(name: Column) -> Column:
    """Whether a name stays only if it occurs twice: one word that is not all upper case."""
    return (F.instr(name, " ") == 0) & ((F.upper(name) != name) | (F.lower(name) == name))


def entity_type(name: Column, text: Column) -> Column:
    """person, org, place or other."""
    w = F.split(name, " ")
    titled = F.rlike(text, F.concat(F.lit(rf"(?<![{W}])(?:{'|'.join(lx.HONORIFICS)})\.?[{WS}]+\Q"), name, F.lit(r"\E")))
    return (
        F.when(name.rlike("[ঀ-৿]"), "other")
        .when(name.isin(lx.DIVISIONS + lx.DISTRICTS), "place")
        .when(name.isin(lx.KNOWN_ORGS), "org")
        .when(titled, "person")
        .when(F.arrays_overlap(w, strings(lx.ORG_WORDS)), "org")
        .when(F.arrays_overlap(w, strings(lx.PLACE_WORDS)), "place")
        .otherwise("other")
    )


def subtype(label: Column, kind: Column) -> Column:
    """the finer type of an organisation or a place; null without a sign of one."""
    w = words(label)
    org = F.coalesce(*[F.when(F.arrays_overlap(w, strings(keys)), name) for name, keys in lx.ORG_SUBTYPES.items()])
    place = F.coalesce(F.when(label.isin(lx.DIVISIONS), "division"), F.when(label.isin(lx.DISTRICTS), "district"), *[F.when(F.arrays_overlap(w, strings(keys)), name) for name, keys in lx.PLACE_SUBTYPES.items()])
    return F.when(kind == "org", org).when(kind == "place", place)


def typed_relation(sentence: Column, a: Column, b: Column) -> Column:
    """(relation, source, target): the first cue between the two names' first occurrences, directed by their order;
    else related_to in the given order."""
    at, bt = F.instr(sentence, a), F.instr(sentence, b)
    first, second = F.when(at <= bt, a).otherwise(b), F.when(at <= bt, b).otherwise(a)
    begin, end = F.least(at, bt) + F.length(first), F.greatest(at, bt)
    gap = F.when((at > 0) & (bt > 0) & (at != bt) & (end - begin <= lx.GAP), F.substring(sentence, begin, F.greatest(end - begin, F.lit(0))))
    cue = F.coalesce(*[F.when(gap.rlike(rf"(?i)(?<![{W}])(?:{p})(?![{W}])"), name) for name, p in lx.CUES])
    return F.struct(
        F.coalesce(cue, F.lit("related_to")).alias("relation"),
        F.when(cue.isNotNull(), first).otherwise(a).alias("source"),
        F.when(cue.isNotNull(), second).otherwise(b).alias("target"),
    )


def facts(parts: Column, names: Column) -> Column:
    """Up to FACTS distinct sentences of usual length that are no table rows, scrubbed and redacted: those that hold a
    name, or any where there are none."""
    usual = F.filter(parts, lambda s: F.length(s).between(*FACT_CHARS) & ~tabular(s))
    shown = lambda ss: F.slice(F.array_distinct(F.filter(F.transform(ss, lambda s: redacted(scrubbed(s))), lambda s: s != "")), 1, FACTS)
    grounded = shown(F.filter(usual, lambda s: F.exists(names, lambda n: F.contains(s, n))))
    return F.when(F.size(grounded) > 0, grounded).otherwise(shown(usual))


def extracted(chunks: DataFrame) -> DataFrame:
    """(id, doc, idx, heading_path, entities, facts, parts) of chunks (id, doc, idx, heading_path, text); `entities` are the
    TOP names with rank, count and type, `parts` the sentences that relations are read from."""
    base = chunks.select("id", "doc", "idx", "heading_path", clean(F.col("text")).alias("text"))
    names = F.array_sort(F.concat(latin_names(F.col("text")), bengali_names(F.col("text"))))
    rows = base.withColumn("names", names).withColumn("parts", sentences_abbreviated(F.col("text")))
    kept = F.filter(counted(F.col("names")), lambda e: ~single(e["name"]) | (e["less"] <= -2))
    rows = rows.withColumn("top", F.slice(F.array_sort(kept), 1, TOP))
    typed = F.transform("top", lambda e, i: F.struct(i.cast("int").alias("rank"), e["name"].alias("name"), (-e["less"]).cast("long").alias("n"), entity_type(e["name"], F.col("text")).alias("type")))
    return rows.select("id", "doc", "idx", "heading_path", typed.alias("entities"), facts(F.col("parts"), F.transform("top", lambda e: e["name"])).alias("facts"), "parts")


def mentions(rows: DataFrame) -> DataFrame:
    """(id, doc, idx, rank, name, n, type) of the names of `extracted` rows."""
    return rows.select("id", "doc", "idx", F.explode_outer("entities").alias("e")).where("e is not null").select("id", "doc", "idx", "e.rank", "e.name", "e.n", "e.type")


def relations(rows: DataFrame) -> DataFrame:
    """(id, source, relation, target) of every pair of names of a chunk, by the first sentence that holds both."""
    pairs = F.flatten(F.transform("entities", lambda a: F.transform(F.filter("entities", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["name"].alias("a"), b["name"].alias("b")))))
    each = rows.select("id", "parts", F.explode_outer(pairs).alias("p")).select("id", "p.a", "p.b", F.get(F.filter("parts", lambda s: F.contains(s, F.col("p.a")) & F.contains(s, F.col("p.b"))), F.lit(0)).alias("s"))
    return each.where("s is not null").select("id", typed_relation(F.col("s"), F.col("a"), F.col("b")).alias("r")).select("id", "r.source", "r.relation", "r.target")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct chunks of the chunks table."""
    return distinct_chunks(table(spark, folder, "chunks", "id", "doc", "heading_path", "text", "idx"))


def mentions_query(spark: SparkSession, folder: str) -> DataFrame:
    """entity_mentions_topn: the names of every chunk."""
    return mentions(extracted(chunk_rows(spark, folder))).select("id", F.col("rank") + 1, "name", "n").toDF("id", "rank", "name", "n")


def types_query(spark: SparkSession, folder: str) -> DataFrame:
    """entity_types: types and finer types of all names, by how many chunks give them."""
    m = mentions(extracted(chunk_rows(spark, folder)))
    return m.select("name", "type", F.coalesce(subtype(F.col("name"), F.col("type")), F.lit("")).alias("subtype")).groupBy("name", "type", "subtype").agg(F.count(F.lit(1)).alias("chunks"))


def relations_query(spark: SparkSession, folder: str) -> DataFrame:
    """typed_relations: relations of every chunk."""
    return relations(extracted(chunk_rows(spark, folder)))


def facts_query(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_facts: facts of every chunk."""
    return extracted(chunk_rows(spark, folder)).select("id", F.posexplode_outer("facts").alias("at", "fact")).where("fact is not null")


def tabular_query(spark: SparkSession, folder: str) -> DataFrame:
    """tabular_pii_facts: for every document whether it reads as a table's row, and how it looks redacted."""
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", tabular(F.col("text")).alias("tabular"), F.sha2(redacted(F.col("text")), 256).alias("redacted"))


def scrub_query(spark: SparkSession, folder: str) -> DataFrame:
    """control_token_scrub: every document wrapped in control tokens and a fence, scrubbed and defanged."""
    wrapped = F.concat(F.lit("<|im_start|> "), F.col("text"), F.lit("  <tool_<tool_call>call>x</ THINK > <<< data >>>"))
    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2(defanged(scrubbed(wrapped)), 256).alias("sha"))


def bengali_query(spark: SparkSession, folder: str) -> DataFrame:
    """bengali_phrases: Bengali phrases by the number of chunks that hold them."""
    rows = chunk_rows(spark, folder).select("id", F.explode_outer(F.array_distinct(bengali_names(clean(F.col("text"))))).alias("name")).where("name is not null")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("chunks"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_S = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = lambda x: f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_CONTROL = rf"<[|｜][^>]{{0,80}}?[|｜]>|</?[{_S}]*(?:{lx.CONTROL_NAMES})[{_S}]*>"


def _sql_scrub(x: str) -> str:
    for _ in range(5):
        x = f"regexp_replace({x}, '{_CONTROL}', '', 'gi')"
    return _STRIP(f"regexp_replace({x}, '[{_S}]{{2,}}', ' ', 'g')")


_DEFANG = lambda x: f"regexp_replace({x}, '<<<[{_S}]*(?:{lx.FENCE_NAMES})[{_S}]*>>>', '[delim]', 'gi')"
# Letters and digits beyond ASCII become _, other characters beyond it - : then the engine's ASCII boundaries are those of Unicode.
_FOLD = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '[{_S}]', ' ', 'g'), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g'), '[^\x00-\x7F]', '-', 'g')"
# The same, but a line's end stays one, so that a name broken over lines is not found.
_FOLD_KEEP = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '[\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', chr(9), 'g'), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g'), '[^\x00-\x7F]', '-', 'g')"
_HEAD = lambda x: f"CASE WHEN contains({x}, ' ') AND list_contains({_sql_list(lx.STOPWORDS)}, split_part({x}, ' ', 1)) THEN substr({x}, strpos({x}, ' ') + 1) ELSE {x} END"
_CHUNKS = "SELECT c.id AS id, c.doc AS doc, c.idx AS idx, text FROM (SELECT text, min({'doc': doc, 'idx': idx, 'id': id}) AS c FROM chunks WHERE text IS NOT NULL GROUP BY text)"
# Names of every chunk, ranked; shared by the queries that start from them.
NAMES_SQL = rf"""
    ch AS ({_CHUNKS}),
    cl AS (SELECT id, doc, idx, replace({_DEFANG(_sql_scrub("text"))}, 'রম্ন', 'রু') AS t FROM ch),
    raw AS (SELECT id, unnest(regexp_extract_all({_FOLD("t")}, '\b[A-Z][a-zA-Z0-9]+(?: +[A-Z][a-zA-Z0-9]+){{0,3}}\b')) AS name FROM cl),
    sp AS (SELECT id, regexp_replace(name, ' +', ' ', 'g') AS name FROM raw),
    h1 AS (SELECT id, {_HEAD("name")} AS name FROM sp),
    h2 AS (SELECT id, {_HEAD("name")} AS name FROM h1),
    la AS (SELECT id, name FROM h2 WHERE length(name) BETWEEN 2 AND 80 AND NOT (NOT contains(name, ' ') AND (regexp_matches(name, '^[0-9A-Fa-f]{{12,}}$') OR (length(name) > 24 AND NOT regexp_matches(name, '[aeiouAEIOU]'))))
           AND NOT regexp_matches(name, '^(?i)unnamed')
           AND len(list_filter(string_split(name, ' '), lambda w: NOT (list_contains({_sql_list(lx.STOPWORDS)}, w) OR list_contains({_sql_list(lx.VALUE_WORDS)}, lower(w))))) > 0),
    br AS (SELECT id, unnest(regexp_extract_all(t, '[ঀ-৿]+(?:[{_S}]+[ঀ-৿]+){{0,3}}')) AS r FROM cl),
    bw AS (SELECT id, list_filter(regexp_split_to_array(r, '[{_S}]+'), lambda w: w != '' AND NOT regexp_matches(w, '^[{lx.BENGALI_DIGITS}]+$')) AS w FROM br),
    bs AS (SELECT id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_sql_list(lx.BENGALI_STOP)}, w[i])) AS k FROM bw),
    be AS (SELECT id, array_to_string(w[k[1]:k[len(k)]], ' ') AS name FROM bs WHERE len(k) > 0),
    cn AS (SELECT id, name, count(*) AS n FROM (FROM la UNION ALL FROM be WHERE length(name) >= 3) GROUP BY ALL),
    kp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, name) AS rank FROM cn WHERE contains(name, ' ') OR (upper(name) = name AND lower(name) != name) OR n >= 2),
    top AS (SELECT id, rank::INTEGER AS rank, name, n FROM kp WHERE rank <= {TOP})"""
_HONOR = rf"'\b(?:{'|'.join(lx.HONORIFICS)})[.]?\s+'"
TYPED_SQL = rf"""
    ty AS (SELECT top.*, doc, idx, CASE WHEN regexp_matches(name, '[ঀ-৿]') THEN 'other'
        WHEN list_contains({_sql_list(lx.DIVISIONS + lx.DISTRICTS)}, name) THEN 'place' WHEN list_contains({_sql_list(lx.KNOWN_ORGS)}, name) THEN 'org'
        WHEN regexp_matches({_FOLD_KEEP("t")}, {_HONOR} || name) THEN 'person'
        WHEN len(list_intersect(string_split(name, ' '), {_sql_list(lx.ORG_WORDS)})) > 0 THEN 'org'
        WHEN len(list_intersect(string_split(name, ' '), {_sql_list(lx.PLACE_WORDS)})) > 0 THEN 'place' ELSE 'other' END AS type
      FROM top JOIN cl USING (id))"""
_ABBR = rf"regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(lx.ABBREVIATIONS)})[.]', '\1\2' || chr(2), 'g')"
PARTS_SQL = rf"""
    sm AS (SELECT id, regexp_replace(regexp_replace({_ABBR}, '([.!?])[{_S}]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([।。！？])[{_S}]*', '\1' || chr(1), 'g') AS t FROM cl),
    pt AS (SELECT id, list_transform(string_split(t, chr(1)), lambda s: {_STRIP(f"regexp_replace(replace(s, chr(2), '.'), '[{_S}]+', ' ', 'g')")}) AS parts FROM sm),
    ps AS (SELECT id, unnest(parts) AS s, unnest(generate_series(1, len(parts))) AS nr FROM pt)"""
_CUES = " ".join(f"WHEN regexp_matches(gap, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{p})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{name}'" for name, p in lx.CUES)
_SUB = lambda t, d: " ".join(f"WHEN len(list_intersect(string_split(name, ' '), {_sql_list(k)})) > 0 THEN '{n}'" for n, k in d.items())
_TAB = lambda x: f"(len(regexp_extract_all({x}, '[|]')) >= 3 OR regexp_matches({x}, '\\p{{Nd}}{{6,}}') OR (len(regexp_extract_all({x}, '[|]')) = 2 AND len(list_filter(string_split({x}, '|'), lambda z: len(list_filter(regexp_split_to_array(z, '[{_S}]+'), lambda y: y != '')) BETWEEN 1 AND 3)) >= 3))"
_USUAL = f"length(s) BETWEEN {FACT_CHARS[0]} AND {FACT_CHARS[1]} AND NOT {_TAB('s')}"

QUERIES = {
    "entity_mentions_topn": mentions_query,
    "entity_types": types_query,
    "typed_relations": relations_query,
    "chunk_facts": facts_query,
    "tabular_pii_facts": tabular_query,
    "control_token_scrub": scrub_query,
    "bengali_phrases": bengali_query,
}
SQL = {
    "entity_mentions_topn": f"WITH {NAMES_SQL} SELECT id, rank, name, n FROM top",
    "entity_types": f"""WITH {NAMES_SQL}, {TYPED_SQL},
    su AS (SELECT name, type, CASE WHEN type = 'org' THEN CASE {_SUB("org", lx.ORG_SUBTYPES)} END
        WHEN type = 'place' THEN CASE WHEN list_contains({_sql_list(lx.DIVISIONS)}, name) THEN 'division' WHEN list_contains({_sql_list(lx.DISTRICTS)}, name) THEN 'district' {_SUB("place", lx.PLACE_SUBTYPES)} END END AS subtype FROM ty)
    SELECT name, type, coalesce(subtype, '') AS subtype, count(*) AS chunks FROM su GROUP BY ALL""",
    "typed_relations": rf"""WITH {NAMES_SQL}, {PARTS_SQL},
    pr AS (SELECT a.id, a.name AS a, b.name AS b FROM top a JOIN top b ON a.id = b.id AND a.rank < b.rank),
    fs AS (SELECT pr.id, a, b, min_by(s, nr) AS s FROM pr JOIN ps ON pr.id = ps.id AND contains(s, a) AND contains(s, b) GROUP BY ALL),
    po AS (SELECT *, strpos(s, a) AS x, strpos(s, b) AS y FROM fs),
    ga AS (SELECT *, CASE WHEN x != y AND greatest(x, y) - least(x, y) - length(CASE WHEN x <= y THEN a ELSE b END) <= {lx.GAP}
        THEN substr(s, least(x, y) + length(CASE WHEN x <= y THEN a ELSE b END), greatest(0, greatest(x, y) - least(x, y) - length(CASE WHEN x <= y THEN a ELSE b END))) END AS gap FROM po),
    cu AS (SELECT *, CASE {_CUES} END AS cue FROM ga)
    SELECT id, CASE WHEN cue IS NULL OR x <= y THEN a ELSE b END AS source, coalesce(cue, 'related_to') AS relation, CASE WHEN cue IS NULL OR x <= y THEN b ELSE a END AS target FROM cu""",
    "chunk_facts": f"""WITH {NAMES_SQL}, {PARTS_SQL},
    us AS (SELECT id, nr, s, regexp_replace({_sql_scrub("s")}, '\\p{{Nd}}{{6,}}', '[number]', 'g') AS fact, len(list_filter(coalesce(names, []), lambda n: contains(s, n))) > 0 AS g FROM ps LEFT JOIN (SELECT id, list(name) AS names FROM top GROUP BY id) USING (id) WHERE {_USUAL}),
    gr AS (SELECT id, bool_or(g AND fact != '') AS held FROM us GROUP BY id),
    fa AS (SELECT id, fact, min(nr) AS nr FROM us JOIN gr USING (id) WHERE fact != '' AND (g OR NOT held) GROUP BY ALL),
    rn AS (SELECT id, fact, row_number() OVER (PARTITION BY id ORDER BY nr) AS r FROM fa)
    SELECT id, (r - 1)::INTEGER AS at, fact FROM rn WHERE r <= {FACTS}""",
    "tabular_pii_facts": f"SELECT doc_id, {_TAB('text')} AS tabular, sha256(regexp_replace(text, '\\p{{Nd}}{{6,}}', '[number]', 'g')) AS redacted FROM documents WHERE text IS NOT NULL",
    "control_token_scrub": "SELECT doc_id, sha256(" + _DEFANG(_sql_scrub("('<|im_start|> ' || text || '  <tool_<tool_call>call>x</ THINK > <<< data >>>')")) + ") AS sha FROM documents WHERE text IS NOT NULL",
    "bengali_phrases": f"WITH {NAMES_SQL} SELECT name, count(DISTINCT id) AS chunks FROM be WHERE length(name) >= 3 GROUP BY name",
}
