"""Chat formatting: reply trees, their best paths, one formatted conversation for each path; SQL functions only.

Paths are found by self-joins whose reach doubles: after i rounds a message knows its ancestor 2**i steps up and the
sum of scores on the way, so a tree of any depth takes as many rounds as its depth has binary digits.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.store import materialise

#: The template: every turn is OPEN role TEXT text END CLOSE. Inside roles and texts one backslash more follows the
#: bracket of anything that looks like a control string, so that no control string stands there and unescape() can tell.
OPEN, TEXT, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_LOOKS = r"([<\[])(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _LOOKS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def best_paths(messages: DataFrame, most: int = 1) -> DataFrame:
    """tree, leaf, node and up (steps above the leaf) of every message on the `most` best root-to-leaf paths of each tree.

    messages: tree, node (unique in its tree), parent (null or unknown at a root), score. Paths rank by their mean score,
    then by leaf; a null score counts 0. Messages that lead into a circle have no root and are on no path.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).join(known, ["tree", "parent"], "left")
    step = materialise(step.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "messages")
    largest = step.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    jumps = [step.where("parent is not null").select("tree", "node", F.col("parent").alias("over"), F.col("score").alias("sum"))]
    while 1 << len(jumps) < 2 * largest:
        last = jumps[-1]
        above = last.select("tree", F.col("node").alias("over"), F.col("over").alias("far"), F.col("sum").alias("more"))
        jumps.append(materialise(last.join(above, ["tree", "over"]).select("tree", "node", F.col("far").alias("over"), (F.col("sum") + F.col("more")).alias("sum")), "jumps"))
    parents = step.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = step.join(parents, ["tree", "node"], "left_anti").join(jumps[-1].select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    # climb to the root by the longest steps first, adding up scores
    climb = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("total"), F.lit(0).alias("steps"))
    for i, jump in reversed([*enumerate(jumps[:-1] or jumps)]):
        climb = climb.join(jump, ["tree", "node"], "left").select("tree", "leaf", F.coalesce("over", "node").alias("node"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"), (F.col("steps") + F.when(F.col("over").isNotNull(), 1 << i).otherwise(0)).alias("steps"))
    root = step.select("tree", "node", F.col("score").alias("root_score"))
    ranked = climb.join(root, ["tree", "node"]).withColumn("mean", (F.col("total") + F.col("root_score")) / (F.col("steps") + 1))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))).where(F.col("rank") <= most)
    path = materialise(ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("up")), "leaves")
    for i, jump in enumerate(jumps[:-1] or jumps):
        both = F.array(F.struct("node", "up"), F.when(F.col("over").isNotNull(), F.struct(F.col("over").alias("node"), (F.col("up") + (1 << i)).alias("up"))))
        path = path.join(jump, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array_compact(both)).alias("p")).select("tree", "leaf", "p.node", "p.up")
    return path


def format_paths(messages: DataFrame, most: int = 1) -> DataFrame:
    """tree, leaf, formatted and loss_spans (start, end: code points of formatted) of the best paths of each tree.

    messages: as for best_paths, and role and text, null for empty. The loss mask is on the texts of the role assistant.
    """
    path = best_paths(messages, most)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(said, ["tree", "node"])
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT))
    turns = turns.select("tree", "leaf", (-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "learn", "start", "end"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\[INST\]")
        role, text = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        return F.struct(unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(F.substring(text, F.lit(1), F.length(text) - len(END))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations that are no trees as messages: every row replies to the one before it by turn, then role and text.

    tree is conv_id as text, so that a null conv_id is a conversation of its own.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    rows = conversations.select(tree.alias("tree"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")))
    return rows.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation (conv_id, turn, role, text); an empty table gives an empty result."""
    messages = materialise(linear_messages(conversations), "turns")
    ids = messages.where("node = 1").select("tree", "conv_id")
    return format_paths(messages).join(ids, "tree").select("conv_id", "formatted", "loss_spans")
