r"""Personal data: patterns, and terms that give away what the patterns found.

Base spans are found by four patterns. Protected entities are the found values and the kinds of them, as most values
occur once. How strongly a term reveals an entity is estimated from co-occurrence in the whole corpus: for kinds, in how
many documents with the term something of the kind was found; for values, how often the term stands within `REACH`
characters of the value. A term discloses an entity if its pointwise mutual information with it is at least `DISCLOSED`
of the entity's own information content. Chance and copies are kept out: the probability of the entity given the term is
taken at the lower end of its Wilson interval at `SURE` deviations, and a term has to stand between different words in
at least `VARIED` of these documents, `SUPPORT` at least, so that copies of one passage prove nothing. Rare identifiers
can't be counted one by one; runs of letters and digits in one are pooled in two shapes, each a term of its own.

Disclosing terms are spans of the kind `term` wherever they stand, but inside of e-mail addresses. In sanitised texts base spans
are generalised to their kind, and disclosing terms to [TERM] or, with `generalise=False`, removed.

All of it is DataFrame operations. Positions come from splitting a text at the matches: the lengths of what lies between
and of the matches add up to where each one begins, in code points; they are added up in blocks, so that texts with
hundreds of thousands of matches take seconds.

Nulls: a null text counts as empty and stays null when sanitised; a null doc_id is carried along. Texts are taken whole,
however long. Repeated rows count as often as they occur and get equal spans; overlapping spans are replaced as one, the
one that begins first giving the label, then the longer one. An empty table gives no rows; `sanitised` keeps all other
columns, whatever their names, as these travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, barrier, written

# The patterns. Quantifiers that can't give anything back are possessive, and where a match can only begin
# at the start of a run (or where the last match ended) the pattern says so; both keep long texts linear. Fewer than 16
# digits are no card, and what is left of a run that is too short is so, too.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these can't match, which spares most texts the pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]{3,}"
#: Runs of letters and digits in one, from 16 characters on and shorter ones.
SHAPES = {
    "<long mixed>": r"(?<![\p{L}\p{N}])(?=\p{L}*+\p{N})(?=\p{N}*+\p{L})[\p{L}\p{N}]{16,}+",
    "<mixed>": r"(?<![\p{L}\p{N}])(?=\p{L}*+\p{N})(?=\p{N}*+\p{L})[\p{L}\p{N}]{3,15}(?![\p{L}\p{N}])",
}
REACH, SUPPORT, DISCLOSED, SURE, VARIED = 40, 3, 0.7, 2.0, 0.5
BLOCK = 256
ALL = [*PATTERNS, "any"]


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def before(values: str, most: bool) -> str:
    """SQL: for each of the integers `values` the sum, or with `most` the greatest, of those before it, or 0; by blocks."""
    total = ("coalesce(array_max({0}), 0)" if most else "aggregate({0}, 0, (a, n) -> a + n)").format
    both = ("greatest({0}, {1})" if most else "{0} + {1}").format
    blocks = f"sequence(0, (size(q.v) - 1) div {BLOCK})"
    sums = f"transform({blocks}, b -> {total(f'slice(q.v, b * {BLOCK} + 1, {BLOCK})')})"
    firsts = f"transform({blocks}, b -> {total('slice(r.sums, 1, b)')})"
    within = total(f"slice(q.v, b * {BLOCK} + 1, i)")
    each = f"flatten(transform(s.firsts, (x, b) -> transform(slice(q.v, b * {BLOCK} + 1, {BLOCK}), (n, i) -> {both('x', within)})))"
    chain = f"transform(array(named_struct('sums', {sums})), r -> transform(array(named_struct('firsts', {firsts})), s -> {each})[0])[0]"
    return f"transform(array(named_struct('v', {values})), q -> CASE WHEN size(q.v) = 0 THEN cast(array() AS array<int>) ELSE {chain} END)[0]"


def located(text: str, pattern: str) -> str:
    """SQL: the matches in `text`, an attribute, as structs of value, start and end."""
    cut, found = f"split({text}, {quoted(pattern)}, -1)", f"regexp_extract_all({text}, {quoted(pattern)}, 0)"
    ahead = before("transform(p.found, (m, k) -> length(p.cut[k]) + length(m))", False)
    one = f"zip_with({ahead}, transform(p.found, (m, k) -> named_struct('value', m, 'gap', length(p.cut[k]))), (x, m) -> named_struct('value', m.value, 'start', x + m.gap, 'end', x + m.gap + length(m.value)))"
    return f"transform(array(named_struct('cut', {cut}, 'found', {found})), p -> {one})[0]"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substr(d, -i, 1) AS int) "
    "ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(d, -i, 1) AS int) + 1) END) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": f"m.value RLIKE {quoted('^' + OCTET + f'([.]{OCTET}){{3}}$')}",
    "card": f"exists(array({digits('m.value')}), d -> length(d) BETWEEN 16 AND 19 AND {LUHN})",
    "phone": f"length({digits('m.value')}) BETWEEN 8 AND 15",
}
EMPTY = "cast(array() AS array<struct<value: string, start: int, end: int>>)"


def with_spans(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, and email, ip, card and phone, the valid matches of each kind in the attribute `text`."""
    out = []
    for kind, pattern in PATTERNS.items():
        may = f"contains({text}, '{NEEDS[kind]}')" + ("" if kind == "email" else f" AND {text} RLIKE '[0-9]'")
        out.append(f"CASE WHEN {may} THEN filter({located(text, pattern)}, m -> {VALID[kind]}) ELSE {EMPTY} END AS {kind}")
    return barrier(rows, *keep, *out)


def without_emails(text: str) -> str:
    return f"CASE WHEN contains({text}, '@') THEN regexp_replace({text}, {quoted(PATTERNS['email'])}, ' ') ELSE {text} END"


def with_terms(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep`, and a row for each distinct term of `text`: words without digits, in lower case, and shapes."""
    plain = barrier(rows, *keep, f"lower({without_emails('text')}) AS plain")
    shapes = ", ".join(f"CASE WHEN plain RLIKE '[0-9]' AND plain RLIKE {quoted(p)} THEN '{name}' END" for name, p in SHAPES.items())
    names = [k.split(" AS ")[-1] for k in keep]
    return plain.selectExpr(*names, f"explode(concat(array_distinct(regexp_extract_all(plain, {quoted(WORD)}, 0)), array({shapes}))) AS term").where("term IS NOT NULL AND NOT term RLIKE '[0-9]'")


def entity(kind: str) -> str:
    """SQL: what stands for a value of the kind, whatever its spelling."""
    return f"concat('{kind}:', " + ("lower(m.value)" if kind == "email" else "m.value" if kind == "ip" else digits("m.value")) + ")"


def contexts(entities: DataFrame) -> DataFrame:
    """A row for each value in each document: entity, the context's hash and its distinct terms."""
    parts = [f"transform({k}, m -> named_struct('entity', {entity(k)}, 'start', m.start, 'end', m.end))" for k in PATTERNS]
    rows = entities.selectExpr("text", f"explode(concat({', '.join(parts)})) AS e").selectExpr("e.entity", f"substr(text, greatest(e.start - {REACH}, 0) + 1, least(e.start, {REACH})) AS before", f"substr(text, e.end + 1, {REACH}) AS after")
    return with_terms(rows.selectExpr("entity", "xxhash64(before, after) AS context", "concat(before, ' ', after) AS text"), "entity", "context")


def information(both: str, term: str, entity_: str, total: str) -> str:
    """SQL: the mutual information of term and entity as a share of the entity's information, from counts; the lower end of what they allow."""
    z = SURE * SURE
    share = f"least(1D, {both} / {term})"
    low = f"({share} + {z / 2} / {term} - {SURE} * sqrt({share} * (1 - {share}) / {term} + {z / 4} / {term} / {term})) / (1 + {z} / {term})"
    return f"CASE WHEN {entity_} > 0 AND {entity_} < {total} THEN 1 - ln(greatest({low}, 1e-12)) / ln({entity_} / {total}) ELSE 0D END"


def disclosing(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(term) of all terms of the corpus that give an entity away; `docs` has `text`, not null."""
    sizes = " + ".join(f"size({k})" for k in PATTERNS)
    entities = written(with_spans(docs, "text", "text").where(f"{sizes} > 0"), "entities")
    found = {k: F.col(k) for k in PATTERNS}
    totals = entities.agg(F.count("*").alias("any"), *[F.sum((F.size(c) > 0).cast("long")).alias(k) for k, c in found.items()]).first()
    total = docs.count()
    # documents with the term in which something of the kind was found
    flags = [f"cast(size({k}) > 0 AS bigint) AS {k}" for k in PATTERNS]
    kinds = with_terms(entities, *flags).groupBy("term").agg(F.count("*").alias("any"), *[F.sum(k).alias(k) for k in PATTERNS]).where(F.col("any") >= support)
    kinds = written(kinds, "kinds")
    # distinct contexts first, each with its count, so that a passage with many copies is a single row
    near = contexts(entities)
    values = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("varied"))
    values = values.where((F.col("varied") >= support) & (F.col("varied") >= VARIED * F.col("n_both")))
    parts = ", ".join(f"transform({k}, m -> {entity(k)})" for k in PATTERNS)
    holders = entities.selectExpr(f"explode(array_distinct(concat({parts}))) AS entity").groupBy("entity").agg(F.count("*").alias("n_entity"))
    values = written(values.join(holders, "entity"), "values")
    terms = kinds.select("term").unionByName(values.select("term")).distinct()
    # counted before they are joined: each task sends a word once, however common it is
    used = written(with_terms(docs.select("text")).groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term"), "used")
    by_kind = kinds.join(used, "term").where(f"greatest({', '.join(information(f'`{k}`', 'n_term', f'{totals[k] or 0}L', f'{total}L') for k in ALL)}) >= {disclosed}").select("term", F.col("any").alias("n_both"))
    by_value = values.join(used, "term").where(f"{information('n_both', 'n_term', 'n_entity', f'{total}L')} >= {disclosed}").select("term")
    # of terms that reveal a kind, how many different neighbours they have in these documents
    open_ = written(by_kind, "open")
    plain = barrier(entities, f"regexp_extract_all(lower({without_emails('text')}), {quoted(WORD)}, 0) AS words")
    around = plain.selectExpr("explode(transform(words, (w, i) -> named_struct('word', w, 'around', xxhash64(get(words, i - 1), get(words, i + 1))))) AS x").select("x.*")
    shape = "CASE " + " ".join(f"WHEN word RLIKE {quoted('^' + p + '$')} THEN '{name}'" for name, p in SHAPES.items()) + " ELSE word END"
    around = around.withColumn("term", F.expr(f"CASE WHEN word RLIKE '[0-9]' THEN {shape} ELSE word END"))
    met = around.join(light(open_.select("term"), "term"), "term", "left_semi").groupBy("term", "around").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("varied"))
    by_kind = open_.join(met, "term").where(f"varied >= {support} AND varied >= {VARIED} * n_both").select("term")
    return written(by_kind.unionByName(by_value).distinct(), "disclosing")


def light(table: DataFrame, column: str) -> DataFrame:
    """Broadcasts a table whose texts in `column`, or in its arrays, come to at most 8 * BROADCAST_ROWS bytes, with 16 for each text and row."""
    texts = F.array_join(column, "") if table.schema[column].dataType.typeName() == "array" else F.col(column)
    many = F.size(column) if table.schema[column].dataType.typeName() == "array" else F.lit(0)
    size = table.agg(F.sum(F.octet_length(texts) + 16 * many + 16).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if size <= 8 * BROADCAST_ROWS else table


def holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """From `text` and `key`: held, the disclosing terms of the text of that key, for texts that have some."""
    rows = with_terms(docs, "key").join(light(terms, "term"), "term", "left_semi")
    # a text has at most as many terms as words, and repeated texts have equal ones
    return written(rows.groupBy("key").agg(F.collect_set("term").alias("held")), "holding")


def term_spans(text: str, held: str) -> str:
    """SQL: where the terms of the array `held` stand in `text`, outside of the spans `email`."""
    words = f"filter({located(text, WORD)}, m -> array_contains({held}, lower(m.value)))"
    shapes = [f"CASE WHEN array_contains({held}, '{name}') THEN {located(text, p)} ELSE {EMPTY} END" for name, p in SHAPES.items()]
    return f"CASE WHEN {held} IS NULL THEN {EMPTY} ELSE filter(concat({words}, {', '.join(shapes)}), m -> NOT exists(email, e -> e.start < m.end AND m.start < e.end)) END"


def marked(docs: DataFrame, text_col: str, keep: list[str], **limits) -> DataFrame:
    """A row for each of `docs`: doc, a struct of the columns `keep`, text (empty for null), and found, the spans (kind, start, end) by kind and start."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    held = holding(rows.select("text", "key"), disclosing(rows.select("text"), **limits))
    rows = rows.join(light(held, "held").withColumnRenamed("key", "at"), F.col("key") == F.col("at"), "left")
    found = with_spans(rows, "text", "doc", "text", "held")
    every = ", ".join(f"transform({k}, m -> named_struct('kind', '{k}', 'start', m.start, 'end', m.end))" for k in PATTERNS)
    terms = f"transform(array_sort({term_spans('text', 'held')}, (x, y) -> x.start - y.start), m -> named_struct('kind', 'term', 'start', m.start, 'end', m.end))"
    return barrier(found, "doc", "text", f"concat({every}, {terms}) AS found")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, counts of each base kind, base_sha256, spans, n_term, and n_spans."""
    rows = marked(docs, text_col, [id_col], **limits)
    listed = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')".format
    counts = [f"cast(size(filter(found, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in [*PATTERNS, "term"]]
    base = listed("filter(found, s -> s.kind <> 'term')")
    return rows.selectExpr(f"doc.`{id_col}` AS doc_id", *counts[:-1], f"sha2({base}, 256) AS base_sha256", f"{listed('found')} AS spans", counts[-1], "cast(size(found) AS bigint) AS n_spans")


def sanitised(docs: DataFrame, text_col: str = "text", generalise: bool = True, **limits) -> DataFrame:
    """The rows and columns of `docs`, with base spans and disclosing terms replaced in the text."""
    rows = marked(docs, text_col, docs.columns, **limits)
    # each span with the end of what earlier ones cover; one that begins inside of these has no label of its own
    ordered = "array_sort(found, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"
    rows = barrier(rows, "doc", "text", f"{ordered} AS found")
    rows = barrier(rows, "doc", "text", "found", f"{before('transform(found, s -> s.end)', True)} AS ahead")
    label = "CASE found[i].kind WHEN 'term' THEN '" + ("[TERM]" if generalise else "") + "' ELSE concat('[', upper(found[i].kind), ']') END"
    # the text between what is covered so far and the next span, then that span's label
    parts = f"transform(ahead, (e, i) -> CASE WHEN found[i].start >= e THEN named_struct('at', e, 'n', found[i].start - e, 'label', {label}) END)"
    left = "substr(text, coalesce(array_max(transform(found, s -> s.end)), 0) + 1)"
    text = f"concat(array_join(transform(array_compact({parts}), p -> concat(substr(text, p.at + 1, p.n), p.label)), ''), {left})"
    changed = f"CASE WHEN size(found) = 0 THEN doc.`{text_col}` ELSE {text} END AS `{text_col}`"
    return rows.selectExpr(*[changed if c == text_col else f"doc.`{c}`" for c in docs.columns])
