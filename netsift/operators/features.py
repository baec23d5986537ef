"""The 74 model features of flows, after the public descriptions of these features.

Times are microseconds, sample deviations are zero below two values, and every statistic of an empty set is zero.
Lengths are payload lengths unless `length` says otherwise. Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.numbering import SPAN, numbered
from netsift.operators.segments import KEY, LEAST, carried, hot_flows, segmented, summaries
from netsift.operators.traffic import canonical_key, endpoints, flag, with_ports
from netsift.schema import COLUMNS
from netsift.sources.folders import checkpointed


def _stats(x, name: str) -> list:
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [zero(F.max(x)).alias(f"{name}_max"), zero(F.avg(x)).alias(f"{name}_mean"), zero(F.min(x)).alias(f"{name}_min"), zero(F.stddev_samp(x)).alias(f"{name}_std")]


def directed(packets: DataFrame) -> DataFrame:
    """Packets with their flow's key, microseconds, and whether the lower endpoint sent them."""
    a, _ = endpoints()
    return canonical_key(with_ports(packets)).withColumn("us", F.unix_micros("timestamp")).withColumn("from_low", a == F.col("low"))


def flow_starts(keyed: DataFrame) -> DataFrame:
    """Each flow's key, first_packet, first_low (whether the lower endpoint sent it) and n, its packets; kept in the shared folder, as
    numbers of flows, directions and sizes all follow from it. Every buffer of this aggregate has a fixed width."""
    return checkpointed(keyed.groupBy(*KEY).agg(F.min("packet_number").alias("first_packet"), F.min_by("from_low", "packet_number").alias("first_low"), F.count("*").alias("n")))


def marked(packets: DataFrame, active_us: int, bulk_us: int) -> DataFrame:
    """Packets with their direction, gaps in microseconds (iat, fwd_iat, bwd_iat), at the last packet of each active period, a run without a gap above
    the threshold, its `active` time, and at the last one of each run of payload packets of one direction what is in it: bulk_n,
    bulk_bytes and bulk_us. All in one order.

    Where packets have `segment`, windows cover a segment each, `first_low` is the flow's, and `carry`, if there, is what they know of others.
    """
    cut = "segment" in packets.columns
    key = (*KEY, "segment") if cut else KEY
    known = lambda x, field: F.coalesce(x, F.col(f"carry.{field}")) if "carry" in packets.columns else x
    more = lambda x, field: x + F.coalesce(F.col(f"carry.{field}"), F.lit(0)) if "carry" in packets.columns else x
    w = Window.partitionBy(*key).orderBy("us", "packet_number")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    iat = F.col("us") - known(F.lag("us").over(w), "last_us")
    first_low = F.min_by("from_low", "packet_number").over(Window.partitionBy(*key))
    rows = packets.withColumn("iat", iat).withColumn("first_low", F.coalesce("first_low", first_low) if cut else first_low)
    rows = rows.withColumn("fwd", F.col("from_low") == F.col("first_low")).withColumn("dst_port", F.when(F.col("first_low"), F.col("high.port")).otherwise(F.col("low.port")))
    same = lambda d, field: F.col("us") - known(F.last(F.when(F.col("fwd") == d, F.col("us")), True).over(before), field)
    opened = known(F.last(F.when(F.col("iat").isNull() | (F.col("iat") > active_us), F.col("us")), True).over(so_far), "active_us")
    after = known(F.lead("us").over(w), "next_us") - F.col("us")
    full, size = F.col("payload_length") > 0, F.when(F.col("payload_length") > 0, F.col("payload_length")).otherwise(0)
    last = known(F.last(F.when(full, F.struct("us", "fwd")), True).over(before), "full")
    rows = rows.select(
        "*", F.when(F.col("fwd"), same(True, "last_fwd")).alias("fwd_iat"), F.when(~F.col("fwd"), same(False, "last_bwd")).alias("bwd_iat"), F.when(after.isNull() | (after > active_us), F.col("us") - opened).alias("active"),
        last.alias("last"), more(F.count_if(full).over(so_far), "run_n").alias("run_n"), more(F.sum(size).over(so_far), "run_bytes").alias("run_bytes"),
    )
    new = F.coalesce((F.col("us") - F.col("last.us") > bulk_us) | (F.col("fwd") != F.col("last.fwd")), F.lit(True))
    rows = rows.withColumn("new", F.when(full, new))
    begun = F.last(F.when(F.col("new"), F.struct((F.col("run_n") - 1).alias("n"), (F.col("run_bytes") - F.col("payload_length")).alias("bytes"), "us")), True).over(so_far)
    if "carry" in packets.columns:  # a run that was open before the segment counts from its own begin
        begun = F.coalesce(begun, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.col("carry.run_us").alias("us")))
    over = known(F.expr(f"lead(new) ignore nulls over (partition by {', '.join(key)} order by us, packet_number)"), "next_new")
    rows = rows.select("*", begun.alias("begun"), (full & F.coalesce(over, F.lit(True))).alias("ends"))
    of = lambda x, y: F.when(F.col("ends"), F.col(x) - F.col(f"begun.{y}"))
    return rows.select("*", of("run_n", "n").alias("bulk_n"), of("run_bytes", "bytes").alias("bulk_bytes"), of("us", "us").alias("bulk_us"))


def marked_by_segments(keyed: DataFrame, starts: DataFrame, active_us: int, bulk_us: int, least: int, most_segments: int | None) -> DataFrame:
    """As `marked`, with hot flows cut into segments; these are read once more for what their segments know of each other."""
    hot = hot_flows(keyed, starts, least, most_segments)
    if hot is None:
        return marked(keyed, active_us, bulk_us)
    cut = segmented(keyed, hot)
    alone = summaries(marked(cut.where("first_low is not null"), active_us, bulk_us), active_us)
    carry = carried(alone, active_us, bulk_us)
    return marked(cut.join(F.broadcast(carry), [*KEY, "segment"], "left"), active_us, bulk_us)


def _bulks(least: int) -> list:
    """Averages over runs of at least so many packets, by direction."""
    per, out = lambda x, n: F.when(n > 0, x / n).otherwise(0.0), []
    for name, side in (("fwd", F.col("fwd")), ("bwd", ~F.col("fwd"))):
        mine = side & (F.col("bulk_n") >= least)
        many, total = F.count_if(mine), lambda c, m=mine: F.sum(F.when(m, F.col(c)).otherwise(0))
        out += [per(total("bulk_bytes"), many).alias(f"{name}_bytes_bulk_avg"), per(total("bulk_n"), many).alias(f"{name}_packet_bulk_avg"), per(total("bulk_bytes"), total("bulk_us") / 1e6).alias(f"{name}_bulk_rate_avg")]
    return out


def flow_features(packets: DataFrame, *, active_us: int = 5_000_000, subflow_us: int = 1_000_000, bulk_us: int = 1_000_000, bulk_least: int = 4, length: str = "payload_length", span: int = SPAN, least: int = LEAST, most_segments: int | None = None) -> DataFrame:
    """case_id, flow_id and the 74 features under their column names, in model order.

    Packets are dealt by flow once and sorted once; one aggregate makes the features, without a further exchange unless a flow is hot.
    A flow with more than `least` packets and more than its share (one of `most_segments`) goes to several tasks, see `segments`.
    """
    keyed = directed(packets)
    starts = flow_starts(keyed)
    p = marked_by_segments(keyed, starts, active_us, bulk_us, least, most_segments)
    size, fwd, bwd = F.col(length), F.col("fwd"), ~F.col("fwd")
    of = lambda side, x: F.when(side, x)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")
    flags = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "cwr": "C", "ece": "E"}
    base = p.groupBy(*KEY).agg(
        F.min("packet_number").alias("first_packet"), F.min_by("dst_port", "packet_number").cast("double").alias("dst_port"), (F.max("us") - F.min("us")).cast("double").alias("flow_duration"),
        *[total(flag(k)).alias(f"{n}_flag_count") for n, k in flags.items()],
        *[total(of(side, flag(k))).alias(f"{d}_{n}_flags") for d, side in (("fwd", fwd), ("bwd", bwd)) for n, k in (("psh", "P"), ("urg", "U"))],
        total(fwd.cast("int")).alias("total_fwd_packet"), total(bwd.cast("int")).alias("total_bwd_packets"), total(of(fwd, size)).alias("total_length_of_fwd_packet"), total(of(bwd, size)).alias("total_length_of_bwd_packet"),
        *_stats(of(fwd, size), "fwd_packet_length"), *_stats(of(bwd, size), "bwd_packet_length"), *_stats(size, "packet_length"), F.coalesce(F.var_samp(size), F.lit(0.0)).alias("packet_length_variance"),
        *_stats(F.col("iat"), "flow_iat"), *_stats(F.col("fwd_iat"), "fwd_iat"), *_stats(F.col("bwd_iat"), "bwd_iat"), total(F.col("fwd_iat")).alias("fwd_iat_total"), total(F.col("bwd_iat")).alias("bwd_iat_total"),
        total(of(fwd, F.col("header_length"))).alias("fwd_header_length"), total(of(bwd, F.col("header_length"))).alias("bwd_header_length"),
        F.coalesce(F.min_by(F.col("tcp_window"), of(fwd & F.col("tcp_window").isNotNull(), F.col("packet_number"))), F.lit(0)).cast("double").alias("fwd_init_win_bytes"),
        F.coalesce(F.min_by(F.col("tcp_window"), of(bwd & F.col("tcp_window").isNotNull(), F.col("packet_number"))), F.lit(0)).cast("double").alias("bwd_init_win_bytes"),
        F.count_if(F.col("iat") > subflow_us).alias("subflows"),
        *_stats(F.when(F.col("active") > 0, F.col("active")), "active"), *_stats(F.when(F.col("iat") > active_us, F.col("iat")), "idle"), *_bulks(bulk_least),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both, seconds = F.col("total_fwd_packet") + F.col("total_bwd_packets"), F.col("flow_duration") / 1e6
    lengths = F.col("total_length_of_fwd_packet") + F.col("total_length_of_bwd_packet")
    rate = lambda x: F.when(F.col("flow_duration") > 0, x / seconds).otherwise(0.0)
    out = base.withColumns({
        "protocol": F.col("protocol_number").cast("double"), "average_packet_size": lengths / both, "fwd_segment_size_avg": per("total_length_of_fwd_packet", "total_fwd_packet"),
        "bwd_segment_size_avg": per("total_length_of_bwd_packet", "total_bwd_packets"), "flow_bytes_s": rate(lengths), "flow_packets_s": rate(both), "down_up_ratio": per("total_bwd_packets", "total_fwd_packet"),
        "subflow_fwd_bytes": per("total_length_of_fwd_packet", "subflows"), "subflow_fwd_packets": per("total_fwd_packet", "subflows"),
        "subflow_bwd_bytes": per("total_length_of_bwd_packet", "subflows"), "subflow_bwd_packets": per("total_bwd_packets", "subflows"),
    })
    # narrow rows are numbered and joined by flow, as everything else is, so that the wide ones stay where they are
    starts = starts.select(*KEY, "first_packet")
    out = out.join(numbered(starts, starts, "flow_id", span=span).drop("first_packet"), list(KEY))
    return out.select("case_id", "flow_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in COLUMNS])
