"""Edges of the document graph: communication, co-recipients, threads and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.profile import strip_all
from docloom.operators.components import connected_components
from docloom.operators.numbering import numbered


#: Tasks for pairs of a message's recipients, for each task of messages: there are more pairs than rows.
PAIR_TASKS = 8
#: Rows of one recipient from which on it is dealt out.
HOT = 50_000
SEPARATOR, ESCAPE = "\x1f", "\x1e"


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (strip_all(F.col(c).cast("string")) != "")


def is_mail() -> Column:
    """An address at either end, a subject or a date: routing blocks have none of these."""
    address = F.coalesce(F.col("source").contains("@"), F.lit(False)) | F.coalesce(F.col("target").contains("@"), F.lit(False))
    return address | _present("subject") | _present("sent_raw")


def drop_routing(rows: DataFrame) -> DataFrame:
    """Rows that are mail."""
    return rows.filter(is_mail())


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def days_between(first: Column, last: Column) -> Column:
    """Whole elapsed days."""
    return F.floor((_micros(last) - _micros(first)) / 86_400_000_000).cast("long")


def least_values(rows: DataFrame, keys: list[str], value: Column, cap: int, out: str, count: str | None = None) -> DataFrame:
    """keys, out: the `cap` least distinct values that are not blank, as evidence text; no group is gathered beyond the cap.

    `count` names a column for the number of these values.
    """
    one = rows.select(*keys, value.cast("string").alias("_v")).filter(F.col("_v").rlike(r"\S")).distinct()
    return least_of(one, keys, cap, out, count)


def least_of(one: DataFrame, keys: list[str], cap: int, out: str, count: str | None = None) -> DataFrame:
    """least_values of rows(keys, _v) whose values are distinct already."""
    group = Window.partitionBy(*keys)
    first = one.withColumns({"_n": F.row_number().over(group.orderBy("_v")), "_k": F.count("*").over(group)}).filter(F.col("_n") <= cap)
    kept = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), "; ").alias("_t"), F.max("_k").alias("_k"))
    more = F.when(F.col("_k") > cap, F.concat(F.lit("; +"), (F.col("_k") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return kept.select(*keys, F.concat("_t", more).alias(out), *([F.col("_k").alias(count)] if count else []))


def top_values(counts: DataFrame, keys: list[str], value: str, n: str, cap: int, out: str) -> DataFrame:
    """keys, out: the `cap` values of counts(keys, value, n) with the largest n, the least first among equals, as text."""
    first = counts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(n).desc(), value))).filter(F.col("_n") <= cap)
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("string").alias("v")))), lambda r: r["v"]), "; ").alias(out))


def communicated_with(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows(src, dst, message_key, doc_id, is_cc, sent_at, subject) to one edge per direction.

    Rows meet by pair in one shuffle of `tasks` tasks, the session's number by default; what is different among them is counted
    there, as rows, and of a pair's evidence only what is shown is gathered.
    """
    keys = ["src", "dst"]
    rows = rows.filter(F.col("src") != F.col("dst")).repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    out = rows.groupBy(*keys).agg(
        F.countDistinct("message_key").alias("weight"),
        F.count("*").alias("n_rows"),
        F.sum(F.col("is_cc").cast("long")).alias("n_cc"),
        F.min("sent_at").alias("first_sent"),
        F.max("sent_at").alias("last_sent"),
    )
    blank = rows.filter(~F.col("doc_id").cast("string").rlike(r"\S")).groupBy(*keys).agg(F.countDistinct("doc_id").alias("_blank"))
    docs = least_values(rows, keys, F.col("doc_id"), fixed.EVIDENCE_CAP, "doc_ids", "_named")
    subjects = least_values(rows, keys, F.col("subject"), fixed.SUBJECT_CAP, "subjects")
    out = out.join(docs, keys, "left").join(blank, keys, "left").join(subjects, keys, "left")
    n_docs = F.coalesce("_named", F.lit(0)) + F.coalesce("_blank", F.lit(0))
    return out.select(
        "src", "dst", F.lit("communicated_with").alias("relation"), F.lit(1).alias("tier"), "weight", "n_rows", n_docs.alias("n_docs"), "n_cc", "first_sent", "last_sent",
        days_between(F.col("first_sent"), F.col("last_sent")).alias("span_days"), F.coalesce("doc_ids", F.lit("")).alias("doc_ids"), F.coalesce("subjects", F.lit("")).alias("subjects"),
    )


def message_counts(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows(src, dst, message_key) to src, dst and weight, the number of different messages; a message without a key is none."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.filter("message_key IS NOT NULL").select("src", "dst", "message_key").distinct()
    return one.select("src", "dst").repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def unordered_pairs(rows: DataFrame, group: str, item: str, carry: list[str] | None = None) -> DataFrame:
    """(group, src, dst, a_*, b_*): pairs of distinct items of a group, src < dst."""
    carry = carry or []
    a = rows.select(group, F.col(item).alias("src"), *[F.col(c).alias(f"a_{c}") for c in carry])
    b = rows.select(group, F.col(item).alias("dst"), *[F.col(c).alias(f"b_{c}") for c in carry])
    return a.join(b, group).filter("src < dst")


def _text(x: Column) -> Column:
    return x.cast("string")


def _escaped(x: Column) -> Column:
    """Without separators; `_plain` gives x again."""
    return F.replace(F.replace(x, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(SEPARATOR), F.lit(ESCAPE + "1"))


def _plain(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(ESCAPE + "1"), F.lit(SEPARATOR)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _hot(rows: DataFrame, column: str) -> DataFrame | None:
    """`column`, parts: the values that more than HOT rows hold, and in how many parts they are dealt; None if there is none."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    found = counts.select(column, F.ceil(F.col("n") / HOT).cast("int").alias("parts")).collect()  # at most a value for HOT rows
    return F.broadcast(rows.sparkSession.createDataFrame(found, f"{column} {rows.schema[column].dataType.simpleString()}, parts int")) if found else None


def co_recipients(rows: DataFrame, tasks: int | None = None, dealt: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """rows(message_key, dst, doc_id, block_index, is_cc, sent_at, subject) to undirected edges of joint recipients.

    Of a recipient's copies of a message the one with the least (doc_id, block_index) tells whether it was a copy, when it
    was sent and its subject. Documents are those of all copies of the message, whoever is named in them; a blank id is none.

    Messages are one row each before they make pairs. A message goes once to each of its recipients but the last, with the list of
    those that follow, its documents and subjects, all packed in one text, as arrays take several times the room; a recipient of more than HOT rows is dealt out by those that follow. Pairs are
    unfolded where they lie, and what they hold is counted and ranked there in one pass, so nothing of a pair moves. `tasks` is the
    number of tasks for messages, the session's by default; recipients get PAIR_TASKS times as many. `dealt` tells that rows lie by
    message already; seen(dst) are rows to count recipients in, which are cheaper than `rows`.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot(rows if seen is None else seen, "dst")
    one = (rows if dealt else rows.repartition(tasks, "message_key")).groupBy("message_key", "dst").agg(
        F.min(F.struct("doc_id", "block_index", "is_cc", "sent_at", "subject")).alias("r"),
        F.collect_set(F.col("doc_id").cast("string")).alias("docs"),
    )
    letters = one.groupBy("message_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("dst", "r.is_cc")))).alias("who"),
        F.min("r.sent_at").alias("first_sent"),
        F.max("r.sent_at").alias("last_sent"),
        F.filter(F.array_distinct(F.flatten(F.collect_list("docs"))), lambda d: d.rlike(r"\S")).alias("docs"),
        F.collect_list(F.col("r.subject").cast("string")).alias("heard"),
    )
    letters = letters.filter("message_key IS NOT NULL AND size(who) > 1").withColumn("subjects", F.array_distinct("heard"))
    times = F.transform("subjects", lambda s: F.size(F.filter("heard", lambda x: x == s)))
    sent = letters.select(F.posexplode("who").alias("_i", "a"), "who", "first_sent", "last_sent", "docs", "subjects", times.alias("times")).filter(F.col("_i") < F.size("who") - 1)
    sent = sent.withColumn("after", F.slice("who", F.col("_i") + 2, F.size("who"))).withColumn("src", F.col("a.dst"))
    near = ["src"]  # tells the task of a pair
    if hot is not None:
        near = ["src", "part"]
        part = lambda x: F.pmod(F.xxhash64(x["dst"]), F.col("parts"))
        sent = sent.join(hot.withColumnRenamed("dst", "src"), "src", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        sent = sent.withColumn("part", F.explode(F.array_distinct(F.transform("after", part)))).withColumn("after", F.filter("after", lambda x: part(x) == F.col("part")))
    both = lambda x: x["is_cc"] & F.col("a.is_cc")
    sorts = [F.transform(F.filter("after", kind), lambda x: x["dst"]) for kind in (both, lambda x: ~both(x), lambda x: both(x).isNull())]
    lists = [F.transform(x, _escaped) for x in (F.concat(*sorts), F.col("subjects"), F.col("docs"))]
    texts = F.concat(F.transform(F.array(*[F.size(x) for x in (*sorts[:2], F.col("after"), F.col("subjects"))], F.size("docs")), _text), F.transform("times", _text), *lists)
    late = F.when(F.col("last_sent") != F.col("first_sent"), F.col("last_sent")).alias("late")
    sent = sent.select(*near, "first_sent", late, F.array_join(texts, SEPARATOR).alias("packed")).repartition(PAIR_TASKS * tasks, *near)

    # Unpacked again. Of each pair: itself (kind 0), its documents (1) and its subjects (2), each with a number of times.
    sent = sent.select(*near, "first_sent", F.coalesce("late", "first_sent").alias("last_sent"), F.split("packed", SEPARATOR, -1).alias("t"))
    sizes = [F.get("t", F.lit(i)).cast("int").alias(k) for i, k in enumerate(("n_yes", "n_no", "n_after", "n_subjects", "n_docs"))]
    sent = sent.select(*near, "first_sent", "last_sent", "t", *sizes)
    cut = lambda start, n: F.slice("t", start + F.lit(6), F.col(n))
    subjects, after = F.col("n_subjects"), F.col("n_after")
    held = lambda kind, v, k: F.struct(F.lit(kind), v, k.cast("long"))
    spoken = F.zip_with(cut(subjects + after, "n_subjects"), cut(F.lit(0), "n_subjects"), lambda s, k: held(2, _plain(s), k))
    named = F.transform(cut(subjects + after + subjects, "n_docs"), lambda d: held(1, _plain(d), F.lit(1)))
    values = F.concat(F.array(held(0, F.lit(None).cast("string"), F.lit(1))), named, spoken)
    # "outer", because Spark would otherwise ask for lists that are not empty before the rows move, where it would pack and unpack them once more.
    unpacked = sent.select(*near, "first_sent", "last_sent", values.alias("values"), "n_yes", "n_no", cut(subjects, "n_after").alias("after"))
    pairs = unpacked.select(*near, "first_sent", "last_sent", "values", "n_yes", "n_no", F.posexplode_outer("after").alias("_i", "b"))
    is_cc = F.when(F.col("_i") < F.col("n_yes"), 1).when(F.col("_i") < F.col("n_yes") + F.col("n_no"), 0).cast("long")
    pairs = pairs.select(*near, _plain(F.col("b")).alias("dst"), is_cc.alias("cc"), "first_sent", "last_sent", "values")
    keys = [*near, "dst"]
    pairs = pairs.select(*keys, "cc", "first_sent", "last_sent", F.inline_outer("values").alias("kind", "v", "k"))
    counted = pairs.groupBy(*keys, "kind", "v").agg(F.sum("k").alias("k"), F.sum("cc").alias("n_cc"), F.min("first_sent").alias("first_sent"), F.max("last_sent").alias("last_sent"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.when(F.col("kind") == 2, -F.col("k")), "v")
    ranked = counted.withColumn("_n", F.row_number().over(order))
    itself, is_doc, is_subject = (F.col("kind") == k for k in range(3))
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(itself, F.col("k"))).alias("weight"),
        F.count(F.when(is_doc, 1)).alias("n_docs"),
        F.max(F.when(itself, F.col("n_cc"))).alias("n_cc"),
        F.min("first_sent").alias("first_sent"),
        F.max("last_sent").alias("last_sent"),
        F.collect_list(F.when(is_doc & (F.col("_n") <= fixed.EVIDENCE_CAP), F.col("v"))).alias("_docs"),
        F.collect_list(F.when(is_subject & (F.col("_n") <= fixed.SUBJECT_CAP), F.struct("_n", "v"))).alias("_subjects"),
    )
    more = F.when(F.col("n_docs") > fixed.EVIDENCE_CAP, F.concat(F.lit("; +"), (F.col("n_docs") - fixed.EVIDENCE_CAP).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(
        "src", "dst", F.lit("co_recipient_of").alias("relation"), F.lit(1).alias("tier"), "weight", "n_docs", "n_cc", "first_sent", "last_sent",
        days_between(F.col("first_sent"), F.col("last_sent")).alias("span_days"), F.concat(F.array_join(F.array_sort("_docs"), "; "), more).alias("doc_ids"),
        F.array_join(F.transform(F.array_sort("_subjects"), lambda r: r["v"]), "; ").alias("subjects"),
    )


def normalise_subject(subject: Column) -> Column:
    """Without reply and forward marks, folded; blank if short or generic."""
    plain = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*(?:(?:re|fw|fwd|fyi)\s*:\s*)+", "")
    plain = F.regexp_replace(F.lower(strip_all(plain)), r"\s+", " ")
    return F.when(plain.isin(*fixed.EMPTY_SUBJECTS) | (F.length(plain) < 4), "").otherwise(plain)


def _spoken(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with a usable subject, participants of messages, messages with their first date)."""
    named = rows.withColumn("subject", normalise_subject(F.col("subject"))).filter("subject <> ''")
    member = named.select("subject", "message_key", F.explode(F.array("src", "dst")).alias("who"), "sent_at").filter("who IS NOT NULL")
    return named, member, member.groupBy("subject", "message_key").agg(F.min("sent_at").alias("sent"))


def threads(rows: DataFrame, window_days: float = fixed.THREAD_WINDOW_DAYS, min_messages: int = fixed.MIN_THREAD_MESSAGES) -> tuple[DataFrame, DataFrame]:
    """rows(message_key, subject, src, dst, sent_at, doc_id) to (thread nodes, participation edges).

    Messages of a subject that share a participant are one thread if at most the window apart; linking
    neighbours in time gives the same components as linking all pairs. An undated message links to all of its
    participant's, so there the neighbour rule holds regardless of the gap.
    """
    _, member, dated = _spoken(rows)
    seats = member.select("subject", "message_key", "who").distinct().join(dated, ["subject", "message_key"])
    order = Window.partitionBy("subject", "who").orderBy(F.col("sent").asc_nulls_first(), "message_key")
    gap = _micros(F.col("sent")) - _micros(F.lag("sent").over(order))
    undated = F.max(F.col("sent").isNull()).over(Window.partitionBy("subject", "who"))
    linked = seats.select("subject", "message_key", F.lag("message_key").over(order).alias("before"), gap.alias("gap"), undated.alias("undated"))
    linked = linked.filter(F.col("before").isNotNull() & (F.col("undated") | (F.col("gap") <= int(window_days * 86_400_000_000))))
    return threads_by_links(rows, linked.select("subject", "message_key", "before"), min_messages)


def threads_by_links(rows: DataFrame, linked: DataFrame, min_messages: int = fixed.MIN_THREAD_MESSAGES) -> tuple[DataFrame, DataFrame]:
    """(thread nodes, participation edges) of rows and links(subject, message_key, before) between their messages."""
    named, _, dated = _spoken(rows)
    name = lambda c: F.concat_ws("\x1f", "subject", c)
    nodes = dated.select(name("message_key").alias("node"))
    roots = connected_components(nodes, linked.select(name("message_key").alias("a"), name("before").alias("b")))
    placed = dated.join(roots, name("message_key") == F.col("node")).select("subject", "message_key", "sent", "root")
    size = placed.groupBy("root").agg(F.count("*").alias("n_messages"), F.min("sent").alias("first_sent"), F.max("sent").alias("last_sent"), F.first("subject").alias("canonical")).filter(F.col("n_messages") >= min_messages)
    ids = numbered(size, [F.col("n_messages").desc(), F.col("root")], "_rank").withColumn("entity_id", F.format_string("THR_%04d", "_rank"))
    inside = placed.join(ids.select("root", "entity_id"), "root").select("subject", "message_key", "entity_id")
    seen = named.join(inside, ["subject", "message_key"])
    edges = seen.select("entity_id", "doc_id", F.explode(F.array("src", "dst")).alias("src")).filter("src IS NOT NULL").groupBy("src", F.col("entity_id").alias("dst")).agg(F.count("*").alias("weight"), F.countDistinct("doc_id").alias("n_docs"))
    people = edges.groupBy("dst").agg(F.count("*").alias("n_participants"))
    nodes = ids.join(people, F.col("dst") == F.col("entity_id")).select("entity_id", F.lit("THREAD").alias("type"), "canonical", "n_messages", "n_participants", "first_sent", "last_sent")
    return nodes, edges.withColumn("relation", F.lit("participated_in")).withColumn("tier", F.lit(1))


def is_noisy(canonical: Column, kind: Column) -> Column:
    """Names of too many tokens, and persons that begin with a salutation."""
    plain = strip_all(F.coalesce(canonical, F.lit("")))
    tokens = F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"\s+")))
    return (tokens > fixed.MAX_ENTITY_TOKENS) | ((kind == "PERSON") & F.coalesce(canonical.rlike("(?i)" + fixed.SALUTATION), F.lit(False)))


def usable_mentions(mentions: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Mentions that are linked, stand in the body and name no entity of exclude(entity_id).

    A chunk's prepended header is on every chunk of its message, so its mentions would count again and again; the
    column in_header tells them, where there is one.
    """
    rows = mentions.filter(F.col("entity_id").isNotNull() & F.col("chunk_id").isNotNull())
    if "in_header" in mentions.columns:
        rows = rows.filter(~F.coalesce("in_header", F.lit(False)))
    return rows if exclude is None else rows.join(exclude.select("entity_id"), "entity_id", "left_anti")


def co_occurs_with(mentions: DataFrame, exclude: DataFrame | None = None, min_entity_df=fixed.MIN_ENTITY_DF, min_pair_df=fixed.MIN_PAIR_DF, min_pair_docs=fixed.MIN_PAIR_DOCS, min_npmi=fixed.MIN_NPMI, max_entities=fixed.MAX_ENTITIES_PER_CHUNK) -> DataFrame:
    """mentions(chunk_id, doc_id, entity_id, in_header) to undirected edges weighted by normalised pointwise mutual information.

    Header mentions and the entities of exclude(entity_id), such as noisy ones, take no part. Rare entities are dropped
    before pairs are made; a chunk makes at most max_entities^2 / 2 pairs.
    """
    once = usable_mentions(mentions, exclude).groupBy("chunk_id", "entity_id").agg(F.min("doc_id").alias("doc_id"))
    width = Window.partitionBy("chunk_id")
    kept = once.withColumn("_n", F.count("*").over(width)).filter(F.col("_n") <= max_entities).drop("_n")
    chunks = kept.agg(F.countDistinct("chunk_id").cast("double").alias("n_chunks"))
    df = kept.groupBy("entity_id").agg(F.count("*").alias("df")).filter(F.col("df") >= min_entity_df)
    frequent = kept.join(df.select("entity_id"), "entity_id", "left_semi")
    by_doc = unordered_pairs(frequent, "chunk_id", "entity_id", ["doc_id"]).groupBy("src", "dst", F.col("a_doc_id").alias("doc_id")).agg(F.count("*").alias("n"))
    counted = by_doc.groupBy("src", "dst").agg(F.sum("n").alias("n_chunks_joint"), F.count("doc_id").alias("n_docs"))
    counted = counted.filter((F.col("n_chunks_joint") >= min_pair_df) & (F.col("n_docs") >= min_pair_docs))
    left, right = (df.select(F.col("entity_id").alias(k), F.col("df").cast("double").alias(f"{k}_df")) for k in ("src", "dst"))
    scored = counted.join(left, "src").join(right, "dst").crossJoin(F.broadcast(chunks))  # one row
    p = F.col("n_chunks_joint") / F.col("n_chunks")
    pmi = F.log(p / ((F.col("src_df") / F.col("n_chunks")) * (F.col("dst_df") / F.col("n_chunks"))))
    npmi = F.when(p >= 1, 1.0).otherwise(pmi / -F.log(p))
    found = scored.withColumn("npmi", npmi).filter(F.col("npmi") >= min_npmi)
    docs = least_values(by_doc.join(found.select("src", "dst"), ["src", "dst"], "left_semi"), ["src", "dst"], F.col("doc_id"), fixed.EVIDENCE_CAP, "doc_ids")
    return found.join(docs, ["src", "dst"], "left").select("src", "dst", F.lit("co_occurs_with").alias("relation"), F.lit(2).alias("tier"), F.round("npmi", 4).alias("weight"), "n_chunks_joint", "n_docs", "npmi", F.coalesce("doc_ids", F.lit("")).alias("doc_ids"))


EDGE_COLUMNS = {
    "src": "string", "dst": "string", "relation": "string", "tier": "int", "weight": "double", "n_rows": "long", "n_docs": "long", "n_cc": "long", "n_chunks_joint": "long", "npmi": "double",
    "first_sent": "timestamp", "last_sent": "timestamp", "span_days": "long", "doc_ids": "string", "subjects": "string",
}
NODE_COLUMNS = {"entity_id": "string", "type": "string", "canonical": "string", "n_aliases": "long", "n_mentions": "long", "addresses": "array<string>"}


def _stacked(parts: tuple[DataFrame, ...], columns: dict[str, str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


def stack_edges(*parts: DataFrame) -> DataFrame:
    """All edge tables as one, with the fixed columns; missing ones are nulls of the column's type."""
    return _stacked(parts, EDGE_COLUMNS)


def stack_nodes(*parts: DataFrame) -> DataFrame:
    """All node tables as one, with the fixed columns; missing ones are nulls of the column's type."""
    return _stacked(parts, NODE_COLUMNS)
