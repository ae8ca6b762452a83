"""Conversation structure repair: window-derived fault flags and a higher-order fold over sorted turns.

A sound conversation has role initials `(s?(ua)+)?`. The cheapest edits that lead there come from a fold
with four states, by what the kept turns so far end with: nothing, a system turn, a user turn, an
assistant turn. Each state is a struct (cost, audit), and `least` picks among such structs: less cost first,
then the audit that is least in ASCII. Two audits of equal cost over the same turns are never one
a prefix of the other (that would take insertions, which cost), so the least of each state stays least.

A conversation of more than PART turns is folded in parts of PART turns, each from every state it may be
entered in, wherever Spark puts them; a second fold chains the parts. So no array grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistola.llm.common import tune

#: Turns of a part.
PART = 1024
#: Characters that make no text, and the ends of whole sentences (fixed values).
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of edits (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The cost of a state that cannot be; any real cost is less.
NEVER = 1 << 50

STATES = ("nothing", "system", "user", "assistant")
_STATE = "struct<" + ",".join(f"{s}:struct<cost:bigint,audit:string>" for s in STATES) + ">"
#: Between the audits of parts. It stands after the same turns in all audits, so it decides no comparison.
_BREAK = "|"


def _then(state: Column, cost: int | Column, letters: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letters)).alias("audit"))


def _when(test: Column, state: Column) -> Column:
    return F.when(test, state)  # least() passes over nulls


def _with_insertions(acc: Column) -> tuple[Column, Column]:
    """The user and assistant states after the insertions that may come before the next turn."""
    user = F.least(acc["user"], *[_then(acc[s], INSERT, "I") for s in ("nothing", "system", "assistant")])
    assistant = F.least(acc["assistant"], _then(acc["user"], INSERT, "I"), *[_then(acc[s], 2 * INSERT, "II") for s in ("nothing", "system")])
    return user, assistant


def _step(acc: Column, turn: Column) -> Column:
    """The four states after one more turn."""
    user, assistant = _with_insertions(acc)
    extra = F.when(turn["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
    free, initial = ~turn["forced"], turn["initial"]
    before_user = F.least(acc["nothing"], acc["system"], assistant)
    return F.struct(
        _then(acc["nothing"], DELETE, "D").alias("nothing"),
        F.least(_then(acc["system"], DELETE, "D"), _when(free & (initial == "s"), _then(acc["nothing"], extra, "K"))).alias("system"),
        F.least(_then(user, DELETE, "D"), _when(free & (initial == "u"), _then(before_user, extra, "K")), _when(free, _then(before_user, extra + REROLE, "R"))).alias("user"),
        F.least(_then(assistant, DELETE, "D"), _when(free & (initial == "a"), _then(user, extra, "K")), _when(free, _then(user, extra + REROLE, "R"))).alias("assistant"),
    )


def _entered(state: Column) -> Column:
    """The four structs with only this state (a number) possible."""
    return F.struct(*[F.struct(F.when(state == i, F.lit(0)).otherwise(F.lit(NEVER)).cast("long").alias("cost"), F.lit("").alias("audit")).alias(s) for i, s in enumerate(STATES)]).cast(_STATE)


def _cheapest(acc: Column) -> Column:
    """(cost, audit) of the cheapest sound ending."""
    return F.least(acc["nothing"], _with_insertions(acc)[1])


def faults(df: DataFrame, key: str, turn: str, role: str, text: str, present: str | None = None) -> DataFrame:
    """One row per turn with its place in the conversation and its faults.

    Windows over one shuffle by conversation: they stream and spill, nothing is gathered. Turns of
    the same number stand in the order of role and text. Nulls in role and text are one space.
    Rows whose `present` is not true only keep their conversation listed.
    """
    here = F.coalesce(F.col(f"`{present}`"), F.lit(False)) if present else F.lit(True)
    rows = df.select(
        F.col(f"`{key}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
        here.alias("here"),
    )
    ordered = Window.partitionBy("conv").orderBy(F.col("here").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = Window.partitionBy("conv", "role", "text").orderBy(F.col("here").desc(), F.col("turn").asc_nulls_first())
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).select(
        "*",
        (F.row_number().over(ordered) - 1).cast("long").alias("place"),
        F.sum(F.col("here").cast("long")).over(whole).alias("turns"),
        F.lag("turn").over(ordered).alias("last_turn"),
        F.lag("initial").over(ordered).alias("last_initial"),
    )
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    ended = F.lit(False)
    for end in ENDS:
        ended = ended | said.endswith(end)
    rows = rows.select("*", (F.row_number().over(same) > 1).alias("again"), (said == "").alias("blank"), (~ended).alias("open"))
    pair = F.concat("last_initial", "initial")
    return rows.select(
        *("conv", "turn", "role", "text", "here", "initial", "place", "turns"),
        F.when(F.col("here"), F.floor(F.col("place") / PART)).otherwise(F.lit(0)).cast("long").alias("part"),
        "blank",
        (~F.col("blank") & F.col("again")).alias("duplicate"),
        (~F.col("blank") & ~F.col("again") & F.col("open")).alias("truncated"),
        ((F.col("place") > 0) & ~F.coalesce(pair.isin("su", "ua", "au"), F.lit(False))).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("turn") != F.col("last_turn")))).alias("new_turn"),
    )


def _counted(name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("here"), F.col(name).cast("long"))), F.lit(0).cast("long")).alias(name)


_FIGURES = ("blank", "duplicate", "truncated", "illegal")


def _parts(turns: DataFrame) -> DataFrame:
    """One row per conversation and part with its turns in order; turns that are not there leave an empty list."""
    one = F.when(F.col("here"), F.struct("place", "role", "text", "initial", (F.col("blank") | F.col("duplicate")).alias("forced"), "truncated"))
    return turns.groupBy("conv", "part", "turns").agg(
        F.array_sort(F.collect_list(one)).alias("list"),
        F.min(F.when(F.col("here"), F.col("turn"))).alias("least"),
        F.max(F.when(F.col("here"), F.col("turn"))).alias("most"),
        _counted("new_turn"),
        *[_counted(f) for f in _FIGURES],
    )


def _gaps() -> Column:
    return F.coalesce(F.col("most") - F.col("least") + 1 - F.col("new_turn"), F.lit(0)).cast("long").alias("gaps")


def _repaired(turns: Column, audit: Column, after: Column) -> Column:
    """The turns that the audit leaves, as array of (edit, role, text); `after` sound turns follow in later parts.

    A sound conversation ends in an assistant turn and alternates from there, so the number of
    turns that follow gives the role of any turn that is not kept as it is.
    """
    kind = "array<struct<edit:string,role:string,text:string>>"

    def piece(p: Column, i: Column) -> Column:
        inserted = F.length(F.regexp_replace(p, "[DKR]", ""))
        turn = F.get(turns, i)
        kept = F.when(p.endswith("K"), F.array(F.struct(F.lit("K").alias("edit"), turn["role"].alias("role"), turn["text"].alias("text"))).cast(kind))
        kept = kept.when(p.endswith("R"), F.array(F.struct(F.lit("R").alias("edit"), F.lit(None).alias("role"), turn["text"].alias("text"))).cast(kind))
        new = F.struct(F.lit("I").alias("edit"), F.lit(None).alias("role"), F.lit("").alias("text"))
        return F.concat(F.array_repeat(new, inserted).cast(kind), kept.otherwise(F.array().cast(kind)))

    left = F.flatten(F.transform(F.regexp_extract_all(audit, F.lit("I*[DKR]|I+"), F.lit(0)), piece))
    n = F.length(F.regexp_replace(audit, "D", "")).cast("long") + after

    def named(t: Column, i: Column) -> Column:
        role = F.coalesce(t["role"], F.when((n - i) % 2 == 1, F.lit("assistant")).otherwise(F.lit("user")))
        return F.struct(t["edit"].alias("edit"), role.alias("role"), t["text"].alias("text"))

    return F.transform(left, named)


def _whole(parts: DataFrame) -> DataFrame:
    """Conversations of one part."""
    done = F.aggregate("list", _entered(F.lit(0)), _step, _cheapest)
    rows = parts.select("*", F.inline(F.array(done)).alias("cost", "audit"))
    return rows.select("conv", "part", F.lit(1).cast("long").alias("parts"), _gaps(), *_FIGURES, "cost", "audit", _repaired(F.col("list"), F.col("audit"), F.lit(0)).alias("repaired"))


def _chain(parts: DataFrame) -> DataFrame:
    """Conversations of several parts: fold each part from every state, chain the parts, hand each part its audit."""
    spread = parts.repartition("conv", "part")  # the parts of one conversation leave the task that has numbered it
    entries = F.when(F.col("part") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(STATES) - 1)))
    exits = F.transform(entries, lambda e: F.aggregate("list", _entered(e), _step))
    folded = spread.select("conv", "part", "least", "most", "new_turn", *_FIGURES, exits.alias("exits"))

    def follow(acc: Column, part: Column) -> Column:
        def reach(state: str) -> Column:
            ways = []
            for i, before in enumerate(STATES):
                leg = F.get(part["exits"], F.lit(i))[state]
                ways.append(F.when(leg.isNotNull(), F.struct((acc[before]["cost"] + leg["cost"]).alias("cost"), F.concat(acc[before]["audit"], leg["audit"], F.lit(_BREAK)).alias("audit"))))
            return F.least(*ways).alias(state)

        return F.struct(*[reach(s) for s in STATES])

    chained = folded.groupBy("conv").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("part", "exits"))), _entered(F.lit(0)), follow, _cheapest).alias("best"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        *[F.sum(c).alias(c) for c in ("new_turn", *_FIGURES)],
    )
    # what follows the last break was inserted behind the last turn
    audits = F.split(F.regexp_replace("best.audit", "[|](I*)$", "$1"), "[|]")
    told = chained.select("conv", _gaps(), *_FIGURES, F.col("best.cost").alias("cost"), F.size(audits).cast("long").alias("parts"), F.posexplode(audits).alias("part", "audit"))
    later = Window.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    told = told.select("*", F.coalesce(F.sum(F.length(F.regexp_replace("audit", "D", ""))).over(later), F.lit(0)).alias("after"))
    texts = parts.select(F.col("conv").alias("c"), F.col("part").alias("p"), "list")
    joined = told.join(texts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv", F.col("part").cast("long").alias("part"), "parts", "gaps", *_FIGURES, "cost", "audit", _repaired(F.col("list"), F.col("audit"), F.col("after")).alias("repaired"))


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row per conversation and part of PART turns: key, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    Figures are those of the whole conversation; audit (a letter per edit: Keep, Rerole, Delete,
    Insert) and repaired (array of edit, role, text) are the part's own. Turns are taken by number, nulls
    first, then role and text; null role or text is one space; repeated turns are duplicates. A null key is
    one conversation. A conversation without turns that are `present` has one row of zeros, an empty audit and
    no turns. An empty table gives an empty table; other columns are ignored. Turn numbers are integers.
    The windows number a conversation in one task, which streams and spills; texts meet only in parts.
    """
    parts = _parts(faults(df, key, turn, role, text, present))
    made = _whole(parts.where(F.col("turns") <= PART)).unionByName(_chain(parts.where(F.col("turns") > PART)))
    return made.withColumnRenamed("conv", key)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The repaired turns of repair() as rows: key, part, position within the part, edit, role, text."""
    key = repaired.columns[0]
    return repaired.select(key, "part", F.posexplode("repaired").alias("position", "turn")).select(key, "part", "position", "turn.edit", "turn.role", "turn.text")


def digest_parts(rows: DataFrame, figures: list[str]) -> DataFrame:
    """One row per conversation: figures, the whole audit and repaired_sha256, from rows (figures, part, parts, audit, n_lines, lines).

    Parts are sorted by conversation and streamed into the digest, so no text longer than a part's is held.
    """
    tune(rows.sparkSession)
    ordered = rows.repartition(figures[0]).sortWithinPartitions(figures[0], "part").select(*figures, "part", "parts", "audit", "n_lines", "lines")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[: len(figures)]) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: list[str] = []
        digest, any_line = hashlib.sha256(), False
        for batch in batches:
            done, made = [], []
            columns = [c.to_pylist() for c in batch.columns[len(figures) :]]
            for i, (part, parts, audit, n, lines) in enumerate(zip(*columns, strict=True)):
                if part == 0:
                    audits, digest, any_line = [], hashlib.sha256(), False
                audits.append(audit)
                if n:
                    digest.update((("\n" if any_line else "") + lines).encode())
                    any_line = True
                if part == parts - 1:
                    done.append(i)
                    made.append(("".join(audits), digest.hexdigest()))
            kept = [c.take(pa.array(done, pa.int64())) for c in batch.columns[: len(figures)]]
            new = [pa.array([m[k] for m in made], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(kept + new, names=[*figures, "audit", "repaired_sha256"])

    return ordered.mapInArrow(run, schema)
