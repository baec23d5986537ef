"""Hot flows in segments: packets of one flow dealt to several tasks, and what each segment must know of the others.

A flow with more packets than a task should take is cut at times that an approximate quantile gives, and within one
microsecond, if that holds many packets, by packet number. So a segment is a stretch of the flow in order of time. What a window over
the whole flow would look back to (last packets, the open active period, the open bulk run) or ahead to (the next packet) is carried from
segment to segment. There are at most a few segments for each shuffle partition, so their summaries may pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("case_id", "low", "high", "protocol_number")
#: Packets that one task takes of a flow at least before the flow is cut; segments for each shuffle partition at most; cut points looked up.
LEAST, PER_PARTITION, CUTS = 500_000, 4, 2000

CARRY = "struct<last_us: long, last_fwd: long, last_bwd: long, active_us: long, full: struct<us: long, fwd: boolean>, run_n: long, run_bytes: long, run_us: long, next_us: long, next_new: boolean>"


def hot_flows(packets: DataFrame, starts: DataFrame, least: int = LEAST, most_segments: int | None = None) -> DataFrame | None:
    """The flows to be cut: key, first_low, size of a segment, cuts (times at which segments begin) and ties (times that fill
    segments by themselves); None if there are none. `starts` has each flow's key, first_low and n, its packets."""
    spark = packets.sparkSession
    most_segments = most_segments or PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = starts.agg(F.sum("n")).first()[0] or 0
    size = max(least, -(-total // most_segments))
    hot = starts.where(F.col("n") > size)
    if hot.isEmpty():
        return None
    steps = min(CUTS, most_segments)
    mine = packets.join(F.broadcast(hot.select(*KEY)), list(KEY), "left_semi")
    points = mine.groupBy(*KEY).agg(F.percentile_approx("us", [k / steps for k in range(1, steps)], 10 * CUTS).alias("points"))
    wanted = F.least(F.lit(steps), F.ceil(F.col("n") / size)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), wanted - 1), lambda j: F.element_at("points", F.greatest(F.lit(1), F.floor(j * steps / wanted).cast("int"))))
    told = hot.join(points, list(KEY)).select(*KEY, "first_low", F.lit(size).alias("size"), cuts.alias("cuts"))
    ties = F.array_distinct(F.filter("cuts", lambda x, k: (k > 0) & (F.get("cuts", k - 1) == x)))
    told = told.withColumn("ties", ties).withColumn("cuts", F.array_sort(F.array_distinct(F.concat("cuts", F.transform("ties", lambda x: x + 1)))))
    rows = told.collect()
    return spark.createDataFrame(rows, told.schema)


def segmented(packets: DataFrame, hot: DataFrame) -> DataFrame:
    """The packets with their flow's first_low, null unless it is hot, and `segment`, in whose order a flow's segments follow one another."""
    told = packets.join(F.broadcast(hot), list(KEY), "left")
    cut = F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("us"))), F.lit(0))
    tie = F.when(F.array_contains("ties", F.col("us")), F.expr("packet_number div size")).otherwise(F.lit(0))
    return told.withColumn("segment", F.struct(cut.alias("cut"), F.coalesce(tie, F.lit(0)).cast("long").alias("tie"))).drop("cuts", "ties", "size")


def summaries(marked: DataFrame, active_us: int) -> DataFrame:
    """One row for each segment of hot flows; `marked` comes from windows over the segments alone."""
    full = F.col("payload_length") > 0
    at = F.struct("us", "packet_number", "fwd")
    broke = F.col("new") & F.col("last.us").isNotNull()
    before = F.struct("us", "packet_number", (F.col("run_n") - 1).alias("n"), (F.col("run_bytes") - F.col("payload_length")).alias("bytes"))
    return marked.groupBy(*KEY, "segment").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(F.when(F.col("fwd"), F.col("us"))).alias("last_fwd"), F.max(F.when(~F.col("fwd"), F.col("us"))).alias("last_bwd"),
        F.max(F.when(F.col("iat") > active_us, F.col("us"))).alias("active"), F.min(F.when(full, at)).alias("first_full"), F.max(F.when(full, at)).alias("last_full"),
        F.count_if(full).alias("full_n"), F.sum(F.when(full, F.col("payload_length")).otherwise(0)).alias("full_bytes"), F.max(F.when(broke, before)).alias("broke"),
    )


def carried(segments: DataFrame, active_us: int, bulk_us: int) -> DataFrame:
    """Key, segment and `carry`, what the segment must know of those before and after it."""
    rows, out, flow = sorted(segments.collect(), key=lambda r: (*[str(r[k]) for k in KEY], r["segment"])), [], None
    later: list = [None] * len(rows)  # for each segment the next one of its flow with payload
    for i in range(len(rows) - 2, -1, -1):
        if all(rows[i][k] == rows[i + 1][k] for k in KEY):
            later[i] = i + 1 if rows[i + 1]["first_full"] else later[i + 1]
    new_run = lambda last, first: last is None or first["us"] - last[0] > bulk_us or first["fwd"] != last[1]
    for i, r in enumerate(rows):
        if (mine := tuple(r[k] for k in KEY)) != flow:
            flow, last, last_fwd, last_bwd, active, full, run = mine, None, None, None, None, None, (0, 0, None)
        follows = i + 1 < len(rows) and tuple(rows[i + 1][k] for k in KEY) == flow
        own = r["last_full"] and (r["last_full"]["us"], r["last_full"]["fwd"])
        next_new = new_run(own, rows[later[i]]["first_full"]) if own and later[i] is not None else None
        out.append((*flow, r["segment"], (last, last_fwd, last_bwd, active, full, *run, rows[i + 1]["first_us"] if follows else None, next_new)))
        if last is None or r["first_us"] - last > active_us:
            active = r["first_us"]
        active = r["active"] if r["active"] is not None else active
        if own:
            first = r["first_full"]
            if new_run(full, first):
                run = (0, 0, first["us"])
            run = (r["full_n"] - r["broke"]["n"], r["full_bytes"] - r["broke"]["bytes"], r["broke"]["us"]) if r["broke"] else (run[0] + r["full_n"], run[1] + r["full_bytes"], run[2])
        last, last_fwd, last_bwd, full = r["last_us"], r["last_fwd"] if r["last_fwd"] is not None else last_fwd, r["last_bwd"] if r["last_bwd"] is not None else last_bwd, own or full
    kinds = [f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in (*KEY, "segment")]
    return segments.sparkSession.createDataFrame(out, ", ".join([*kinds, f"carry {CARRY}"]))
