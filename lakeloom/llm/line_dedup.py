"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the number of a line's tokens, then its leading
tokens. Tokens with digits are variable fields from the start. In a leaf with
several different lines, the most frequent token of each position makes a
template; lines that agree with it in enough positions belong to it, and the
positions where they differ are variable too. The other lines of the leaf go
to its children by their token at the position that tells the fewest kinds
apart, and vote there again, for a fixed number of levels. What is left then
is a template of its own. So the templates depend on the lines alone, not on
their order. A template that recurs across documents is dropped from all of
them but the first, so that of a group of copies one stays whole.

Only leaves that recur matter: their hashes set the bits of a table of a fixed
size, which is broadcast, and lines whose bit is not set never travel. Hot
lines, leaves and templates are summed before they are shuffled, and joined by
``skew_join``. Texts move once, to meet the list of what goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import bound
from lakeloom.operators.joins import key_sizes, skew_join
from lakeloom.session import cut, n_partitions

#: log2 of the bits of the table of leaves: 2**17 rows of 64 bits at most are broadcast.
BITS = 23


def plain(line: Column) -> Column:
    """A line with its tokens one space apart."""
    flat = F.trim(F.when(line.contains("\t") | line.contains("\r"), F.translate(line, "\t\r", "  ")).otherwise(line))
    return F.when(flat.contains("  "), F.regexp_replace(flat, " +", " ")).otherwise(flat)


def n_tokens(flat: Column) -> Column:
    return F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "))) + 1


def form(flat: Column, min_tokens: int) -> Column:
    """What of a plain line is compared: tokens with digits as a wildcard, in lines of enough tokens."""
    masked = F.regexp_replace(flat, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")
    return F.when((n_tokens(flat) >= min_tokens) & flat.rlike("[0-9]"), masked).otherwise(flat)


def _leaves(docs: DataFrame, min_tokens: int, min_chars: int, lead: int) -> DataFrame:
    """doc, code, line (its form), leaf (0: the line takes no part) of each line."""
    shown = docs.select("doc", "code", F.explode(F.split("body", "\n")).alias("line")).select("doc", "code", plain(F.col("line")).alias("flat"))
    shown = shown.select("doc", "code", n_tokens(F.col("flat")).alias("n"), F.length("flat").alias("chars"), form(F.col("flat"), min_tokens).alias("line"))
    short = F.when(F.col("chars") >= min_chars, F.xxhash64(F.lit(0), "line")).otherwise(F.lit(0).cast("long"))
    fields = F.octet_length("line") == 4 * F.col("n") - 1  # as long as wildcards alone
    blank = fields & (F.replace(F.replace(F.col("line"), F.lit("<*>")), F.lit(" ")) == "")
    long = F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64("n", F.substring_index("line", " ", lead)))
    return shown.select("doc", "code", "line", F.when(F.col("n") >= min_tokens, long).otherwise(short).alias("leaf"))


def _templates(lines: DataFrame, similar: float, min_docs: int, levels: int) -> DataFrame | None:
    """leaf, seq, template of those lines (leaf, seq, weight, line) that belong to a template with variable positions."""
    left, general = lines.withColumn("node", F.col("leaf")), None
    for _ in range(levels + 1):
        tokens = left.select("node", "weight", F.posexplode(F.split("line", " ")).alias("position", "token"))
        votes = tokens.groupBy("node", "position", "token").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("k"))
        spots = votes.groupBy("node", "position").agg(F.max(F.struct("weight", "token")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("docs"), F.sum("k").alias("k"))
        tops = F.transform(F.array_sort(F.collect_list(F.struct("position", "top.token"))), lambda x: x["token"])
        apart = F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "position")))["position"]
        table = spots.groupBy("node").agg(tops.alias("tops"), apart.alias("apart"), F.max("k").alias("k"), F.max("docs").alias("docs"))
        # one line alone, or lines in too few documents, make no template
        table = cut(table.where((F.col("k") > 1) & (F.col("docs") >= min_docs)).drop("docs"))
        sizes = key_sizes(table, "k")
        if not sizes[0]:
            break
        own = F.split("line", " ")
        same = F.size(F.filter(F.zip_with(own, F.col("tops"), lambda a, b: a == b), lambda x: x))
        judged = skew_join(left, table, ["node"], "k", sizes=sizes)
        judged = cut(judged.select("leaf", "seq", "weight", "line", "node", (same >= similar * F.size(own)).alias("fits"), F.xxhash64("node", F.get(own, F.col("apart"))).alias("child")))
        fits = judged.where("fits").select("leaf", "seq", F.xxhash64("node", F.lit("*")).alias("template"))
        general = fits if general is None else general.union(fits).coalesce(n_partitions(lines.sparkSession))
        left = judged.where("not fits").select("leaf", "seq", "weight", "line", F.col("child").alias("node"))
    return general


def line_dedup(df: DataFrame, min_docs: int = 3, min_tokens: int = 4, min_chars: int = 16, lead: int = 3, similar: float = 0.8, levels: int = 3, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose template recurs in ``min_docs`` documents or more, but from the first of them.

    Returns id_col, the new ``text_col``, ``_n_lines`` and ``_n_dropped``; with
    carry, ``_n_lines``, ``_n_dropped``, ``_text`` and a struct ``_row`` of the
    columns of df. lead: leading tokens that the tree looks at. similar: share
    of a line's tokens that must agree with a template. levels: how often a
    leaf is divided. Lines of fewer than ``min_tokens`` tokens have no variable
    fields; those that are also shorter than ``min_chars`` characters, and
    lines of nothing but fields with digits, always stay.

    Defined cases: a null text stays null and has no lines; an empty text has
    one empty line, which stays; the first document is that with the smallest
    id (null first) and among equal ids that with the smallest hash of its
    text; repeated rows count as one document and get the same result; a
    document all of whose lines go is left with an empty text; an empty table
    gives an empty result; other columns are passed on, whatever their names.
    """
    known = F.col(id_col).isNotNull()
    docs = df.select(
        F.struct(known.alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id")).alias("doc"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("code"),
        F.col(text_col).alias("body"),
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_col]).alias("rest")] if carry else []),
    )
    lines = _leaves(docs, min_tokens, min_chars, lead)

    # Leaves that recur, as bits; repeated lines of a document count here, so there may be too many of them.
    often = lines.groupBy("leaf").agg(F.sum((F.col("leaf") != 0).cast("int")).alias("n")).where(F.col("n") >= min_docs)
    slot = F.col("leaf").bitwiseAND((1 << BITS) - 1)
    word, bit = F.shiftrightunsigned(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    table = cut(often.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    # one condition on both sides: a filter on the leaf alone would be pushed below, and the leaf made twice
    mine = F.when(F.col("leaf") == 0, F.lit(0).cast("long")).otherwise(F.col("bits").bitwiseAND(bit))
    likely = lines.withColumn("word", word).join(F.broadcast(table), "word").where(mine != 0)
    seen = cut(likely.select("doc", "code", "leaf", F.xxhash64("line").alias("seq"), "line").distinct())

    seqs = seen.groupBy("leaf", "seq", "line").agg(F.count(F.lit(1)).alias("weight"))
    leaves = cut(seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), (F.min("seq") != F.max("seq")).alias("mixed")).where(F.col("n") >= min_docs))
    common = cut(skew_join(seqs, leaves, ["leaf"], "n").select("leaf", "seq", "weight", F.when(F.col("mixed") & (n_tokens(F.col("line")) >= min_tokens), F.col("line")).alias("line")))
    general = _templates(common.where(F.col("line").isNotNull()), similar, min_docs, levels)
    exact = F.xxhash64("leaf", "seq")
    named = common.select("leaf", "seq", "weight", exact.alias("template")) if general is None else common.join(general, ["leaf", "seq"], "left").select("leaf", "seq", "weight", F.coalesce("template", exact).alias("template"))
    # no template has more documents than rows
    sums = named.groupBy("template").agg(F.sum("weight").alias("rows"), F.count(F.lit(1)).alias("k")).where(F.col("rows") >= min_docs).select("template", "k")
    named = cut(skew_join(named, cut(sums), ["template"], "k").select("leaf", "seq", "weight", "template"))

    held = cut(skew_join(seen.select("doc", "code", "leaf", "seq"), named, ["leaf", "seq"], "weight").select("doc", "code", "seq", "template"))
    recurring = (
        held.groupBy("template", "doc", "code").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min(F.struct("doc", "code")).alias("first"))
        .where(F.col("docs") >= min_docs).select("template", "n", "first")
    )
    gone = skew_join(held, cut(recurring), ["template"], "n").where(F.struct("doc", "code") != F.col("first"))
    gone = gone.groupBy("doc", "code").agg(F.collect_set("seq").alias("gone"))

    done = docs.join(gone.hint("shuffle_hash"), ["doc", "code"], "left")
    every = F.split("body", "\n")
    # A line's hash is the same whatever the document; that of a line that takes no part is never in the list.
    kept = F.filter(every, lambda x: ~F.array_contains(F.col("gone"), bound(plain(x), lambda flat: F.xxhash64(form(flat, min_tokens)))))
    done = done.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.size(every)).cast("long")
    n_dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long")
    if carry:
        row = F.struct(*[F.col("body" if c == text_col else f"rest.c{i}").alias(c) for i, c in enumerate(df.columns)])
        return done.select(n_lines.alias("_n_lines"), n_dropped.alias("_n_dropped"), text.alias("_text"), row.alias("_row"))
    return done.select(F.when(F.col("doc.known"), F.col("doc.id")).alias(id_col), text.alias(text_col), n_lines.alias("_n_lines"), n_dropped.alias("_n_dropped"))


def _level_sql(level: int) -> str:
    """The votes of one level of the tree, the lines that fit and those that go to the level below."""
    lines = "select leaf, t, weight, leaf as node from mixed" if not level else f"select leaf, t, weight, child as node from judged{level - 1} where not fits"
    return f"""
from{level} as (
  select * from ({lines}) x where node in (select node from ({lines}) y group by node having count(*) > 1 and sum(weight) >= 3)
), votes{level} as (
  select node, i, token, sum(weight) as weight from (select node, weight, unnest(t) as token, generate_subscripts(t, 1) as i from from{level}) v group by all
), spots{level} as (
  select node, i, max(case when r = 1 then token end) as top, count(*) as kinds
  from (select *, row_number() over (partition by node, i order by weight desc, encode(token) desc) as r from votes{level}) v group by all
), table{level} as (
  select node, list(top order by i) as tops, arg_min(i, kinds * 1000000 + i) filter (kinds > 1) as apart from spots{level} group by node
), judged{level} as (
  select f.leaf, f.t, f.weight, f.node, list_sum(list_transform(list_zip(f.t, m.tops), lambda p: case when p[1] = p[2] then 1 else 0 end)) >= 0.8 * len(f.t) as fits,
         f.node || chr(3) || f.t[m.apart] as child
  from from{level} f join table{level} m on f.node = m.node
)"""


#: The same in SQL, for DuckDB; min_docs 3, min_tokens 4, min_chars 16, lead 3, similar 0.8, levels 3.
LINE_DEDUP_SQL = rf"""
with parts as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
), flat as (
  select doc_id, pos, line, regexp_replace(trim(translate(line, chr(9) || chr(13), '  ')), ' +', ' ', 'g') as f from parts
), toks as (
  select doc_id, pos, line, f, len(string_split(f, ' ')) as n,
         string_split(case when len(string_split(f, ' ')) >= 4 then regexp_replace(f, '[^ ]*[0-9][^ ]*', '<*>', 'g') else f end, ' ') as t
  from flat
), lines as (
  select doc_id, pos, t, n, case when n >= 4 then array_to_string([cast(n as varchar), t[1], t[2], t[3]], chr(1)) else chr(2) || f end as leaf
  from toks where case when n >= 4 then len(list_filter(t, lambda x: x <> '<*>')) > 0 else length(f) >= 16 end
), seen as (
  select doc_id, leaf, t, n from lines group by all
), leaves as (
  select leaf, count(distinct t) > 1 and min(n) >= 4 as mixed from seen group by leaf having count(*) >= 3
), mixed as (
  select s.leaf, s.t, count(*) as weight from seen s join leaves l on s.leaf = l.leaf where l.mixed group by s.leaf, s.t
), {",".join(map(_level_sql, range(4)))}, general as (
  {" union all ".join(f"select leaf, t, node || chr(4) as template from judged{i} where fits" for i in range(4))}
), named as (
  select s.doc_id, s.t, coalesce(g.template, s.leaf || chr(5) || array_to_string(s.t, ' ')) as template
  from seen s join leaves l on s.leaf = l.leaf left join general g on s.leaf = g.leaf and s.t = g.t
), recurring as (
  select template, min(doc_id) as first_doc from named group by template having count(distinct doc_id) >= 3
), gone as (
  select distinct n.doc_id, n.t from named n join recurring r on n.template = r.template where n.doc_id <> r.first_doc
), marked as (
  select k.doc_id, k.pos, k.line, g.t is not null as dropped from toks k left join gone g on k.doc_id = g.doc_id and k.t = g.t
)
select doc_id, count(*) as n_lines, cast(sum(case when dropped then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(case when not dropped then line end, chr(10) order by pos), '')) as kept_sha256
from marked group by doc_id
union all
select doc_id, 0, 0, sha256('') from documents where text is null
"""
