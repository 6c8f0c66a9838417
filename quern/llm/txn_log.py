"""Transaction log reassembly: an interleaved log of many sources folded into commits, in SQL functions alone.

A log record is a change of a key, a savepoint, a rollback, a commit or an abort. Each source runs one transaction
after the other; all commits share one store.

1. The log is dealt into blocks of ascending position. What has to be counted along the log (a source's
   transactions, all commits, epochs) is counted within blocks and carried over by the blocks' totals, so no source,
   however many records it has, passes one task.
2. A transaction's records are sorted arrays of bounded size, its segments, which a higher-order aggregate folds: it
   carries the live changes, each with the number of savepoints below it, and what rollbacks undo. A rollback
   that finds no savepoint in its segment also reaches into earlier ones.
3. A second fold over a transaction's segments, which are one in nearly all cases, finds what such rollbacks undo.
4. What is left of committed transactions feeds windows by key: the change of the store from one epoch to the next,
   summed up along the epochs.

Tables that grow with the log are joined by a merge on both sides' keys; none is broadcast.

Defined cases: records without a position are no part of the log. A null source is a source like any other. Records
that share a position follow by kind, key and value; equal ones are as many records. A null key is a key. An empty log has
no rows; a log without commits has no epochs. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Kinds of records.
CHANGE, SAVEPOINT, ROLLBACK, ABORT, COMMIT = range(5)
#: Blocks of the log: a block is what one task holds, the totals of all blocks are one small table.
BLOCKS = 256
#: Most records of a transaction that are folded in one array.
SEGMENT = 512
#: Commits of an epoch.
EPOCH = 4

_MOVED = "array<struct<pos:bigint,by:bigint,key:bigint>>"
_BEFORE = (W.unboundedPreceding, -1)


def running(rows: DataFrame, per: list[str], order: list[str], what: Column, name: str) -> DataFrame:
    """Adds the sum of ``what`` over the rows of the same ``per`` before this one, by ``block`` and then ``order``."""
    rows = rows.withColumn("~x", what.cast("long"))
    own = F.sum("~x").over(W.partitionBy("block", *per).orderBy(*order).rowsBetween(*_BEFORE))
    totals = rows.groupBy("block", *per).agg(F.sum("~x").alias("~t"))
    carried = F.sum("~t").over(W.partitionBy(*per).orderBy("block").rowsBetween(*_BEFORE))
    totals = totals.select("block", *per, F.coalesce(carried, F.lit(0)).alias("~t"))
    both = rows.withColumn("~o", F.coalesce(own, F.lit(0))).join(totals.hint("merge"), ["block", *per])
    return both.withColumn(name, F.col("~o") + F.col("~t")).drop("~x", "~o", "~t")


def _fold(records: Column) -> Column:
    """(live, depth, undone, pops) of sorted records that follow records not known here.

    depth: savepoints set here and still there. pops: positions of rollbacks that reach back beyond the first record.
    """
    zero = F.struct(
        F.array().cast("array<struct<at:bigint,pos:bigint,key:bigint,value:bigint,depth:int>>").alias("live"), F.lit(0).alias("depth"), F.array().cast(_MOVED).alias("undone"), F.array().cast("array<bigint>").alias("pops")
    )

    def step(s: Column, r: Column) -> Column:
        op, depth, live = r["op"], s["depth"], s["live"]
        new = F.array(F.struct(r["at"].alias("at"), r["pos"].alias("pos"), r["key"].alias("key"), r["value"].alias("value"), depth.alias("depth")))
        since = F.transform(F.filter(live, lambda c: c["depth"] == depth), lambda c: F.struct(c["pos"].alias("pos"), r["pos"].alias("by"), c["key"].alias("key")))
        return F.struct(
            F.when(op == CHANGE, F.concat(live, new)).when(op == ROLLBACK, F.filter(live, lambda c: c["depth"] < depth)).otherwise(live).alias("live"),
            F.when(op == SAVEPOINT, depth + 1).when(op == ROLLBACK, F.greatest(depth - 1, F.lit(0))).otherwise(depth).alias("depth"),
            F.when(op == ROLLBACK, F.concat(s["undone"], since)).otherwise(s["undone"]).alias("undone"),
            F.when((op == ROLLBACK) & (depth == 0), F.concat(s["pops"], F.array(r["pos"]))).otherwise(s["pops"]).alias("pops"),
        )

    return F.aggregate(records, zero, step)


def _across(segments: Column) -> Column:
    """(stack, gone) of a transaction's sorted segments (seg, pops, depth): which depth of which segment a later one's rollback undoes.

    A segment's changes of depth 0 belong to the savepoint that was open before it. So a rollback takes the top depth of
    the last segment that has a savepoint of its own left, and all of the segments after that one.
    """
    events = F.flatten(
        F.transform(segments, lambda s: F.concat(F.transform(s["pops"], lambda p: F.struct(s["seg"].alias("seg"), p.alias("by"), F.lit(0).alias("depth"))), F.array(F.struct(s["seg"].alias("seg"), F.lit(None).cast("bigint").alias("by"), s["depth"].alias("depth")))))
    )
    zero = F.struct(F.array().cast("array<struct<seg:bigint,depth:int>>").alias("stack"), F.array().cast("array<struct<seg:bigint,depth:int,by:bigint>>").alias("gone"))

    def step(s: Column, e: Column) -> Column:
        stack = s["stack"]
        # number of segments up to the last one with a savepoint of its own
        last = F.coalesce(F.array_max(F.transform(stack, lambda x, i: F.when(x["depth"] > 0, i + 1).otherwise(0))), F.lit(0))
        hit = F.filter(stack, lambda x, i: i + 1 >= last)
        rest = F.transform(F.slice(stack, F.lit(1), last), lambda x, i: F.struct(x["seg"].alias("seg"), F.when(i + 1 == last, x["depth"] - 1).otherwise(x["depth"]).alias("depth")))
        gone = F.transform(hit, lambda x: F.struct(x["seg"].alias("seg"), x["depth"].alias("depth"), e["by"].alias("by")))
        push = F.concat(stack, F.array(F.struct(e["seg"].alias("seg"), e["depth"].alias("depth"))))
        return F.struct(F.when(e["by"].isNull(), push).otherwise(rest).alias("stack"), F.when(e["by"].isNull(), s["gone"]).otherwise(F.concat(s["gone"], gone)).alias("gone"))

    return F.aggregate(events, zero, step)


def reassemble(log: DataFrame, *, blocks: int = BLOCKS, segment: int = SEGMENT, epoch: int = EPOCH) -> tuple[DataFrame, DataFrame]:
    """What became of each change of a log (pos, source, op, key, value), and the store after each epoch.

    Changes: (pos, key, value, fate, by, commit, epoch, at); fate is committed, abort or rollback, by the position of the
    record that undid it (null: the log's end), commit and epoch count from 1, at orders the changes of a commit. A change whose value is null deletes its key.
    States: (epoch, n_keys, total) with the number of keys stored and the sum of their values. Both are, or rest on, tables in the shared folder.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    records = log.where("pos is not null").select(F.col("pos").cast("long").alias("pos"), source.alias("src"), F.col("op").cast("int").alias("op"), F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value"))
    put = materialise(records.repartitionByRange(blocks, "pos").withColumn("block", F.spark_partition_id()), "log")

    order = ["pos", "op", "key", "value"]
    row = F.row_number().over(W.partitionBy("block", "src").orderBy(*order)).cast("long")
    placed = running(put, ["src"], order, F.col("op") >= ABORT, "txn").withColumn("at", row)
    seg = F.shiftleft(F.col("block").cast("long"), 32) + F.floor((F.col("at") - 1) / segment)
    arrays = placed.withColumn("seg", seg).groupBy("block", "src", "txn", "seg").agg(F.array_sort(F.collect_list(F.struct("at", *order))).alias("records"))
    ended = F.element_at("records", -1)
    folded = arrays.withColumn("f", _fold(F.col("records"))).select("src", "txn", "seg", "f.*", F.when(ended["op"] >= ABORT, F.struct(ended["op"].alias("op"), ended["pos"].alias("pos"), F.col("block").alias("block"))).alias("end"))
    segments = materialise(folded, "segments")

    whole = segments.groupBy("src", "txn").agg(F.array_sort(F.collect_list(F.struct("seg", "pops", "depth"))).alias("all"), F.max("end").alias("end"))
    whole = materialise(whole.select("src", "txn", "end.*", _across(F.col("all"))["gone"].alias("gone")), "transactions")
    commits = running(whole.where(F.col("op") == COMMIT).select("src", "txn", "pos", "block"), [], ["pos", "src", "txn"], F.lit(1), "n")
    commits = materialise(commits.select("src", "txn", (F.col("n") + 1).alias("commit"), (F.floor(F.col("n") / epoch) + 1).alias("epoch")), "commits")

    known = segments.drop("end").join(whole.withColumnRenamed("pos", "end_pos").hint("merge"), ["src", "txn"]).join(commits.hint("merge"), ["src", "txn"], "left")
    known = known.withColumn("mine", F.filter("gone", lambda g: g["seg"] == F.col("seg")))
    fate = lambda f: F.lit(f).alias("fate")
    here = F.transform("undone", lambda u: F.struct(u["pos"].alias("pos"), u["key"].alias("key"), F.lit(None).cast("bigint").alias("value"), fate("rollback"), u["by"].alias("by"), F.lit(0).cast("bigint").alias("at")))

    def left(c: Column) -> Column:
        by = F.try_element_at(F.transform(F.filter("mine", lambda g: g["depth"] == c["depth"]), lambda g: g["by"]), F.lit(1))
        how = F.when(by.isNotNull(), "rollback").when(F.col("op") == COMMIT, "committed").otherwise("abort")
        return F.struct(c["pos"].alias("pos"), c["key"].alias("key"), c["value"].alias("value"), how.alias("fate"), F.coalesce(by, F.when(F.col("op") == ABORT, F.col("end_pos"))).alias("by"), c["at"].alias("at"))

    changes = known.select("commit", "epoch", "seg", F.explode(F.concat(here, F.transform("live", left))).alias("c")).select("c.pos", "c.key", "c.value", "c.fate", "c.by", "commit", "epoch", F.struct("seg", "c.at").alias("at"))
    changes = materialise(changes, "changes")
    return changes, _states(changes, commits, blocks)


def _states(changes: DataFrame, commits: DataFrame, blocks: int) -> DataFrame:
    """(epoch, n_keys, total) from what each epoch does to each key."""
    n = commits.agg(F.max("epoch")).first()[0] or 0
    step = max(1, -(-n // blocks))
    block = F.floor((F.col("epoch") - 1) / step).alias("block")
    kept = changes.where("fate = 'committed'").groupBy("key", "epoch").agg(F.max_by(F.struct("value"), F.struct("commit", "at")).alias("last"))
    kept = kept.select(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")).alias("key"), "epoch", block, F.struct(F.col("last.value").alias("value")).alias("last"))
    # the value before a key's first change in a block is that after its last one in the blocks before
    ends = kept.groupBy("key", "block").agg(F.max_by("last", "epoch").alias("last"))
    ends = ends.select("key", "block", F.lag("last").over(W.partitionBy("key").orderBy("block")).alias("carried"))
    seen = kept.withColumn("before", F.lag("last").over(W.partitionBy("key", "block").orderBy("epoch"))).join(ends.hint("merge"), ["key", "block"])
    was, now = F.coalesce("before", "carried")["value"], F.col("last.value")
    there = lambda c: c.isNotNull().cast("long")
    moved = seen.select("epoch", (there(now) - there(was)).alias("dn"), (F.coalesce(now, F.lit(0)) - F.coalesce(was, F.lit(0))).alias("dv"))
    zero = F.lit(0).cast("long")
    each = moved.unionByName(commits.select("epoch", zero.alias("dn"), zero.alias("dv"))).groupBy("epoch").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    each = each.select("epoch", "dn", "dv", block)
    out = running(running(each, [], ["epoch"], F.col("dn"), "n"), [], ["epoch"], F.col("dv"), "v")
    return out.select("epoch", (F.col("n") + F.col("dn")).alias("n_keys"), (F.col("v") + F.col("dv")).alias("total"))


def log_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents as a log: what a record does follows from the CRC-32 of its doc_id; a change's value is the CRC-32 of ``key:text``.

    A null text, or a row of labels with toxic = 1, makes a change a deletion.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    m = h % 23
    op = F.when(m <= 1, COMMIT).when(m == 2, ABORT).when(m <= 4, SAVEPOINT).when(m <= 6, ROLLBACK).otherwise(CHANGE)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("pos"), F.col("source").cast("string").alias("source"), op.alias("op"), F.when(op == CHANGE, F.floor(h / 100) % 300).alias("key"), "text")
    rows = rows.select("pos", "source", "op", "key", F.when(F.col("op") == CHANGE, F.crc32(F.concat_ws(":", F.col("key").cast("string"), F.col("text")).cast("binary"))).alias("value"), (F.col("text").isNull()).alias("none"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("pos"), F.lit(True).alias("bad")).distinct()
    return rows.join(toxic.hint("merge"), "pos", "left").select("pos", "source", "op", "key", F.when(~F.col("none") & F.col("bad").isNull(), F.col("value")).alias("value"))


def op11_txn_log(spark, sf_dir: str) -> DataFrame:
    """op11 over the whole of documents: (kind, id, n, value) of the state after each epoch and of each undone change."""
    log = log_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    changes, states = reassemble(log)
    undone = changes.where("fate <> 'committed'").select(F.col("fate").alias("kind"), F.col("pos").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("n_keys").alias("n"), F.col("total").alias("value")).unionByName(undone)
