"""Rule-based events out of clusters of discordant pairs: rule tables, selection of the smallest, demotion of losers.

A rule is a row of SQL expressions over an anchor `i` and a partner `k`, whose
columns are s1, s2 (first and last start), m1, m2 (first and last mate start)
and t (strand type). The engine joins candidates by overlap of their spans and
evaluates all rules in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import overlap_join


@dataclass(frozen=True)
class Rule:
    name: str
    types: tuple[int, int]
    when: str
    start: str
    end: str
    mate_start: str
    mate_end: str
    deleted: str
    inserted: str
    distance: str


def cov(a1: str, a2: str, b1: str, b2: str) -> str:
    """Closed overlap, whichever way round the ends stand, as SQL."""
    return f"(least({a1}, {a2}) <= greatest({b1}, {b2}) and least({b1}, {b2}) <= greatest({a1}, {a2}))"


# The composite events on one chromosome.
INTRA = (
    Rule("inssd", (3, 0), f"k.s1 < i.s1 and {cov('i.s1', 'i.s2', 'k.s2', 'k.m1')} and {cov('k.m1', 'k.m2', 'i.s1', 'i.m2')} and i.s1 <> k.s2", "k.s2", "i.s1", "k.m1", "i.m2", "i.s1 - k.s2 - 1", "i.m2 - k.m1 + 1", "k.m1 - i.s1"),
    Rule("inssu", (3, 0), f"i.m2 < k.m2 and {cov('k.s1', 'k.s2', 'i.s1', 'i.m2')} and {cov('i.m1', 'i.m2', 'k.s2', 'k.m1')}", "i.m2", "k.m1", "i.s1", "k.s2", "k.m1 - i.m2 - 1", "k.s2 - i.s1 + 1", "i.m2 - k.s2"),
    Rule("invers", (1, 2), f"i.s1 < k.s1 and i.s2 < k.s2 and i.m1 < k.m1 and i.m2 < k.m2 and {cov('k.s1', 'k.s2', 'i.s2', 'i.m2')} and {cov('i.m1', 'i.m2', 'k.s1', 'k.m1')}", "i.s2", "k.s1", "i.m2", "k.m1", "k.s1 - i.s2 - 1", "i.m2 - k.s1", "k.m1 - i.m2"),
    Rule("insod", (1, 2), f"i.s1 < k.s1 and {cov('k.s1', 'k.s2', 'i.s2', 'i.m2')} and {cov('k.m1', 'k.m2', 'i.s2', 'i.m2')}", "i.s2", "k.s1", "k.m1", "i.m2", "k.s1 - i.s2 - 1", "i.m2 - k.m1 + 1", "k.m1 - k.s1"),
    Rule("insou", (1, 2), f"i.m2 < k.m2 and {cov('i.s1', 'i.s2', 'k.s1', 'k.m1')} and {cov('i.m1', 'i.m2', 'k.s1', 'k.m1')}", "i.m2", "k.m1", "k.s1", "i.s2", "k.m1 - i.m2 - 1", "i.s2 - k.s1 + 1", "i.m2 - i.s2"),
)

# What is left of a composite event of which one cluster is lost, by (event, lost side), with start and end.
DEMOTED = (
    ("inssd", 1, "del", "start", "mate_start"),
    ("inssd", 2, "tandem_dup", "end", "mate_end"),
    ("inssu", 1, "del", "mate_end", "end"),
    ("inssu", 2, "tandem_dup", "mate_start", "start"),
    ("insod", 1, "invers_r", "end", "mate_start"),
    ("insod", 2, "invers_f", "start", "mate_end"),
    ("insou", 1, "invers_r", "mate_start", "end"),
    ("insou", 2, "invers_f", "mate_end", "start"),
    ("invers", 1, "invers_r", "end", "mate_end"),
    ("invers", 2, "invers_f", "start", "mate_start"),
)


def event_name(rule: str, read_len: int) -> str:
    """SQL: the plain event, or with `del_` before it if what is deleted is at least a read long. An inversion is plain if its junction windows overlap."""
    if rule == "invers":
        w = lambda a, b: cov(f"{a} - 10", f"{a} + {read_len}", f"{b} - {read_len}", f"{b} + 10")
        return f"case when {w('i.s2', 'k.s1')} and {w('i.m2', 'k.m1')} then 'invers' else 'del_invers' end"
    deleted = next(r.deleted for r in INTRA if r.name == rule)
    return f"case when {deleted} < {read_len} then '{rule}' else 'del_{rule}' end"


def intra_events(clusters: DataFrame, read_len: int, largest: int) -> DataFrame:
    """All composite events of pairs of clusters on one chromosome.

    `clusters` has pid, chrom, s1, s2, m1, m2, t. Out: pid, partner, rule,
    event, start, end, mate_start, mate_end, deleted, inserted, distance.
    """
    i = clusters.select(*[F.col(c).alias(f"i_{c}") for c in clusters.columns]).withColumns({"i_lo": F.least("i_s1", "i_m1"), "i_hi": F.greatest("i_s2", "i_m2")})
    k = clusters.select(*[F.col(c).alias(f"k_{c}") for c in clusters.columns]).withColumns({"k_lo": F.least("k_s1", "k_m1"), "k_hi": F.greatest("k_s2", "k_m2")})
    hits = overlap_join(i.where("i_t in (1, 3)"), k.where("k_t in (0, 2)"), [("i_chrom", "k_chrom")], ("i_lo", "i_hi"), ("k_lo", "k_hi")).where("i_pid <> k_pid")
    flat = lambda sql: sql.replace("i.", "i_").replace("k.", "k_")
    made = F.filter(
        F.array(
            *[
                F.when(
                    F.expr(flat(f"i_t = {r.types[0]} and k_t = {r.types[1]} and {r.when} and abs({r.deleted}) < {largest} and abs({r.inserted}) < {largest}")),
                    F.struct(F.lit(r.name).alias("rule"), F.expr(flat(event_name(r.name, read_len))).alias("event"), *[F.expr(flat(getattr(r, f))).alias(f) for f in ("start", "end", "mate_start", "mate_end", "deleted", "inserted", "distance")]),
                )
                for r in INTRA
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return hits.select(F.col("i_pid").alias("pid"), F.col("k_pid").alias("partner"), F.col("i_chrom").alias("chrom"), F.explode(made).alias("x")).select("pid", "partner", "chrom", "x.*")


def smallest(events: DataFrame) -> DataFrame:
    """Of the three smallest candidates of an anchor the first; an inversion among the others wins over a small insertion of the other orientation (both sizes below 20, more than 20 apart)."""
    size = F.abs("deleted") + F.abs("inserted")
    ranked = events.withColumn("no", F.row_number().over(Window.partitionBy("pid").orderBy(size, "rule", "partner"))).where("no <= 3")
    per = Window.partitionBy("pid")
    small = F.max((F.col("no") == 1) & F.col("rule").isin("insod", "insou") & (F.abs("deleted") < 20) & (F.abs("inserted") < 20) & (F.abs("distance") > 20)).over(per)
    other = F.min(F.when(F.col("rule") == "invers", F.col("no"))).over(per)
    ranked = ranked.withColumns({"small": small, "other": other})
    return ranked.where("no = if(small and other is not null, other, 1)").drop("no", "small", "other")


def demote(events: DataFrame) -> DataFrame:
    """Keeps for each cluster its smallest event, as anchor or partner; an event that lost one of its clusters becomes what the other supports, one that lost both goes.

    Out: pid, partner, event, start, end, state (`kept` or `demoted`).
    """
    size = F.abs("deleted") + F.abs("inserted")
    events = events.withColumn("key", F.struct(size.alias("size"), "rule", "pid", "partner"))
    claims = events.select(F.col("pid").alias("c"), "key").unionByName(events.select(F.col("partner").alias("c"), "key"))
    best = claims.groupBy("c").agg(F.min("key").alias("best"))
    one, two = best.select(F.col("c").alias("pid"), F.col("best").alias("b1")), best.select(F.col("c").alias("partner"), F.col("best").alias("b2"))
    held = events.join(one, "pid").join(two, "partner").withColumns({"w1": F.col("key") == F.col("b1"), "w2": F.col("key") == F.col("b2")})
    kept = held.where("w1 and w2").select("pid", "partner", "event", "start", "end", F.lit("kept").alias("state"))
    lost = F.when(F.col("w1") & ~F.col("w2"), 2).when(~F.col("w1") & F.col("w2"), 1)
    table = None
    for rule, side, name, start, end in DEMOTED:
        hit = (F.col("rule") == rule) & (F.col("side") == side)
        new = F.struct(F.lit(name).alias("event"), F.col(start).alias("start"), F.col(end).alias("end"))
        table = F.when(hit, new) if table is None else table.when(hit, new)
    down = held.withColumn("side", lost).where("side is not null").withColumn("n", table).select("pid", "partner", "n.event", "n.start", "n.end", F.lit("demoted").alias("state"))
    return kept.unionByName(down)


def single_event() -> Column:
    """Event, start, end, size of one cluster alone: deletion, inversion by its forward or reverse side, tandem duplication, translocation."""
    return F.expr("""case
      when chrom <> mate_chrom then named_struct('event', 'transl_inter', 'start', if(t in (0, 1), s2, s1), 'end', if(t in (1, 3), m2, m1), 'size', cast(null as bigint))
      when t = 0 and m1 - s2 - 1 > 0 then named_struct('event', 'del', 'start', s2, 'end', m1, 'size', m1 - s2 - 1)
      when t = 1 then named_struct('event', 'invers_f', 'start', s2, 'end', m2, 'size', m2 - s2)
      when t = 2 then named_struct('event', 'invers_r', 'start', s1, 'end', m1, 'size', m1 - s1)
      when t = 3 then named_struct('event', 'tandem_dup', 'start', s1, 'end', m2, 'size', m1 - s1) end""")


#: What stands for a homology that is not known.
UNKNOWN_HOMOLOGY = 1_000


def refined(df: DataFrame, read_len: int, spacer: int = 100) -> DataFrame:
    """`df` (event, start, end, bp0, bp1, between) with bounds after local alignment: `start`, `end`, `size`, `inserted`, `homology`; events without a size go.

    Both called bounds have a window a read long on both sides; where the windows
    meet they are one sequence, else two with a spacer between. `bp0` and `bp1`
    are places in it, from 1, 0 for none, which keeps the called bound. Bases
    `between` (more than 0) make a deletion one with an insertion; negative ones
    are a homology, unknown if `bp0` is.
    """
    c = F.col
    one_sequence = (c("start") + read_len >= c("end") - read_len) & (c("end") + read_len >= c("start") - read_len)
    left = F.when(c("bp0") == 0, c("start")).otherwise(c("start") - read_len + c("bp0") - 1)
    far = F.when(one_sequence, c("start") - read_len + c("bp1") - 1).otherwise(c("end") - read_len + c("bp1") - (2 * read_len + spacer) - 2)
    right = F.when(c("bp1") == 0, c("end")).otherwise(far)
    rows = df.withColumns({"left": left, "right": right, "between": F.when(c("bp0") == 0, -UNKNOWN_HOMOLOGY).otherwise(c("between"))})
    more = (c("event") == "del") & (c("between") > 0)
    size = c("right") - c("left") - F.when(c("event") == "del", 1).otherwise(0)
    rows = rows.withColumns({"size": size, "inserted": F.when(more, c("between")), "homology": F.when(~more, -c("between")), "event": F.when(more, "del_ins").otherwise(c("event"))})
    return rows.where("size > 0").drop("start", "end", "bp0", "bp1", "between").withColumnsRenamed({"left": "start", "right": "end"})


def mechanism(event: str, homology: str, inserted: str, element: str, inserted_element: str, simple: str, inserted_simple: str) -> str:
    """SQL: the mechanism of an event, first that fits, by what is deleted and, for composite events, what is inserted."""
    return f"""case
      when {event} = 'del' then case when {element} is not null then 'TEI' when {simple} then 'VNTR' when {homology} > 100 then 'NAHR' when {homology} >= 2 then 'alt-EJ' else 'NHEJ' end
      when {event} in ('del_inssd', 'del_inssu', 'del_insod', 'del_insou') then case when {element} is not null and {inserted_element} is not null then 'TEA' when {inserted_element} is not null then 'TEI' when {simple} and {inserted_simple} then 'VNTR' when {inserted} <= 10 then 'NHEJ' else 'NA' end
      when {event} in ('inssd', 'inssu', 'insod', 'insou') then case when {inserted_element} is not null then 'TEI' when {inserted_simple} then 'VNTR' else 'NA' end
      when {event} = 'del_invers' then 'FoSTeS'
      when {event} = 'tandem_dup' then case when {simple} then 'VNTR' else 'NA' end
      else 'NA' end"""
