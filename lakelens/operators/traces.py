"""Run logs: spend, budgets, costs of turns, tool calls, sessions, replays, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_MESSAGES, IP_DAILY, GLOBAL_DAILY = 15, 0.10, 0.50
#: Dollars for a million tokens in, out and read from a cache.
RATES = (0.10, 0.50, 0.01)


def spend(runs: DataFrame, *by: str) -> DataFrame:
    """Dollars, cents and runs by any columns; missing costs count nothing.

    Dollars are added in billionths, as whole numbers, which add up the same in any order; cents are those of each run, rounded.
    """
    whole = lambda unit: F.coalesce(F.sum(F.round(F.col("cost") * unit).cast("long")), F.lit(0))
    return runs.groupBy(*by).agg((whole(1_000_000_000) / 1_000_000_000).alias("usd"), whole(100).alias("cents"), F.count(F.lit(1)).alias("runs"))


def verdict(messages: Column, ip_spend: Column, global_spend: Column) -> Column:
    """What a person may do: their own limits refuse, the limit of all turns to recorded sessions; own limits come first."""
    return F.when(messages >= SESSION_MESSAGES, "deny: session").when(ip_spend >= IP_DAILY, "deny: network").when(global_spend >= GLOBAL_DAILY, "replay").otherwise("allow")


def budget_gate(runs: DataFrame, unit: float = 1.0) -> DataFrame:
    """run_id and the verdict on the turn after it: its session's messages, its network's and everyone's spend that day.

    runs: run_id, session_id, network, day, ts, cost. Sums up to a run are within its session and day; a day's sums over
    everyone are made from sums by minute, so that no day is ordered run by run.
    """
    cents = runs.withColumn("cents", F.round(F.coalesce("cost", F.lit(0.0)) * 100 * unit).cast("long"))
    upto = lambda *by: Window.partitionBy(*by).orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = cents.withColumn("minute", F.date_trunc("minute", "ts"))
    rows = rows.withColumn("messages", F.count(F.lit(1)).over(upto("session_id"))).withColumn("ip_cents", F.sum("cents").over(upto("network", "day")))
    minutes = rows.groupBy("day", "minute").agg(F.sum("cents").alias("m"))
    w = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select("day", "minute", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("before"))
    rows = rows.join(minutes, ["day", "minute"]).withColumn("day_cents", F.col("before") + F.sum("cents").over(upto("day", "minute")))
    return rows.select("run_id", "messages", verdict(F.col("messages"), F.col("ip_cents") / 100, F.col("day_cents") / 100).alias("verdict"))


def turn_costs(calls: DataFrame) -> DataFrame:
    """turn_id, tokens_in, tokens_out, every_call_priced, usd: the provider's figures if every call has a sound one, else by rates; and tools.

    calls: turn_id, fresh_in, out, cache_read, reported, tool_usd. A figure is sound if it is finite and not below zero.
    """
    r = F.col("reported")
    sound = F.coalesce((r >= 0) & ~F.isnan(r) & (r < F.lit(float("inf"))), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = calls.groupBy("turn_id").agg(total("fresh_in").alias("fresh"), total("out").alias("tokens_out"), total("cache_read").alias("cached"), F.bool_and(sound).alias("every_call_priced"), total(F.when(sound, r).otherwise(0.0)).alias("provider"), total("tool_usd").alias("tools"))
    rated = (F.col("fresh") * RATES[0] + F.col("tokens_out") * RATES[1] + F.col("cached") * RATES[2]) / 1_000_000
    usd = F.when(F.col("every_call_priced"), F.col("provider")).otherwise(rated) + F.col("tools")
    return out.select("turn_id", (F.col("fresh") + F.col("cached")).alias("tokens_in"), "tokens_out", "every_call_priced", F.round(usd, 9).alias("usd"))


CALLS = "array<struct<name:string,ok:boolean,args:map<string,string>,citations:array<struct<chunk_id:string,paper_id:string>>>>"


def tool_calls(json: Column) -> Column:
    """The calls of a run; one without citations has none."""
    calls = F.from_json(json, CALLS)
    empty = F.array().cast("array<struct<chunk_id:string,paper_id:string>>")
    return F.transform(calls, lambda c: c.withField("citations", F.coalesce(c["citations"], empty)))


def citations_by_paper(calls: DataFrame) -> DataFrame:
    """run_id, paper_id, place and chunk_ids: distinct chunks of each paper by first appearance, papers likewise.

    calls: run_id, citations (array of chunk_id, paper_id, in order).
    """
    rows = calls.select("run_id", F.posexplode("citations").alias("at", "c")).groupBy("run_id", F.col("c.paper_id").alias("paper_id"), F.col("c.chunk_id").alias("chunk_id")).agg(F.min("at").alias("at"))
    papers = rows.groupBy("run_id", "paper_id").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "chunk_id"))).alias("l"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first"))
    return papers.select("run_id", "paper_id", place.alias("place"), F.col("l.chunk_id").alias("chunk_ids"))


def replay(runs: DataFrame) -> DataFrame:
    """run_id, seq, event: of each run its calls and their results, in order, then the text, the cost and the end.

    runs: run_id, calls (array of names), answer, usd.
    """
    pairs = F.flatten(F.transform("calls", lambda c: F.array(F.concat(F.lit("call "), c), F.concat(F.lit("result "), c))))
    end = F.array(F.concat(F.lit("text "), F.coalesce("answer", F.lit(""))), F.concat(F.lit("cost "), F.col("usd").cast("string")), F.lit("done"))
    return runs.select("run_id", F.posexplode(F.concat(pairs, end)).alias("seq", "event"))


def live_sessions(runs: DataFrame, gap: str = "1 hour") -> DataFrame:
    """session_id, start, end and runs of each stretch without a pause beyond the gap."""
    w = F.session_window("ts", gap)
    return runs.groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("runs")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "runs")


REDACTIONS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "key": r"AKIA[A-Z0-9]{12,}", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"}


def redactions(rows: DataFrame, text: str) -> DataFrame:
    """kind and n: how often each kind of private text stands in all rows."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).alias("n")) for k, p in REDACTIONS.items()])
    return rows.select(F.explode(counts).alias("c")).groupBy("c.kind").agg(F.sum("c.n").alias("n"))


def redact(text: Column) -> Column:
    for kind, pattern in REDACTIONS.items():
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def transcript_index(conversations: DataFrame, stored: DataFrame, most: int = 1500) -> dict[str, DataFrame]:
    """chunks of conversations without private text, the stored vectors that stay, and the chunks that need one.

    conversations: conv_id, turn, role, text; stored: chunk_id, hash, of the vectors made before.
    """
    from lakelens.operators.evals import content_hash, vector_state
    from lakelens.operators.ordered import greedy_groups, turns

    rows = conversations.withColumn("text", redact(F.col("text")))
    rows = turns(rows, "conv_id", [F.asc("turn")], F.col("role") == "user").filter("turn_no > 0")
    whole = rows.groupBy("conv_id", F.col("turn_no").cast("long").alias("turn_no")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))  # the rows of one turn
    whole = whole.select("conv_id", "turn_no", F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text")).withColumn("size", F.length("text"))
    placed = whole.join(greedy_groups(whole, "conv_id", "turn_no", "size", most), ["conv_id", "turn_no"])
    name = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("group").cast("string"))
    chunks = placed.groupBy("conv_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min("turn_no").alias("pos_start"), F.max("turn_no").alias("pos_end"))
    chunks = chunks.select(name.alias("chunk_id"), F.col("conv_id").alias("doc_id"), "text", "pos_start", "pos_end")  # bounded by `most`
    kept = vector_state(stored, chunks, "chunk_id").filter("state = 'kept'").select("chunk_id")
    todo = chunks.join(kept, "chunk_id", "left_anti").withColumn("hash", content_hash(F.col("text")))
    return {"chunks": chunks, "kept": kept, "todo": todo}
