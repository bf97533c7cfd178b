r"""Chat formatting: a template with a grammar, and a round trip that proves it. DataFrame functions only.

Grammar of a formatted conversation::

    conversation = "<chat " level ">\n" turn*
    turn         = "### " role ": " body "</turn>\n"

The two control strings are the opener ``### role: `` and the closer ``</turn>``. The parser is deterministic: it cuts at
every closer and before every opener, wherever they stand, so a text that holds either of them reads back as other
turns than the source. Such a conversation is rendered again at the next level of escaping until what the parser
recovers is the source:

* level 0: texts as they are;
* level 1: ``\`` doubled, and the control strings themselves broken (``<\/turn>``, ``#\##``);
* level 2: ``\`` doubled, and a ``\`` before every ``#`` and ``/``, after which neither control string can occur.

Roles are escaped at every level. The level stands in the header, so that a reader needs the text alone.

Defined cases: a null text or role counts as empty; a null turn comes before the others; rows that share a turn are
taken by role, then text, and repeated rows are repeated turns; texts and conversations of any length are taken whole, in time
proportional to their length (a conversation is one row, and so one task's); a null conv_id is a conversation of its own; no rows give
no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENER = r"### [^\n:]{0,64}: "
CLOSER = "</turn>"
LEVELS = 3
BLOCK = 256


def _escape_role(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("#", "\\#"), ("/", "\\/"), (":", "\\c"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _unescape_role(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\c", "$1:"), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return _unescape(c)


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\/#])", "$1")


def _escape(c: Column, level: int) -> Column:
    if level == 0:
        return c
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    pairs = ((CLOSER, "<\\/turn>"), ("###", "#\\##")) if level == 1 else (("/", "\\/"), ("#", "\\#"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _render(turns: Column, level: int) -> Column:
    one = lambda t: F.concat(F.lit("### "), _escape_role(t["role"]), F.lit(": "), _escape(t["text"], level), F.lit(CLOSER + "\n"))
    return F.concat(F.lit(f"<chat {level}>\n"), F.concat_ws("", F.transform(turns, one)))


def _pieces(rendered: Column) -> Column:
    """The parser's cuts: what stands between closers, cut again before each opener."""
    rest = F.regexp_replace(rendered, r"\A<chat \d>\n", "")
    closed = F.split(rest, r"</turn>\n?")
    closed = F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0)))  # after the last closer nothing is left
    return F.flatten(F.transform(closed, lambda p: F.split(p, f"(?={OPENER})")))


def parse(rendered: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation, from its text alone."""
    escaped = ~rendered.startswith("<chat 0>")

    def turn(p: Column) -> Column:
        body = F.regexp_replace(p, r"\A### [^\n:]*: ", "")
        return F.struct(
            _unescape_role(F.regexp_extract(p, r"\A### ([^\n:]*): ", 1)).alias("role"),
            F.when(escaped, _unescape(body)).otherwise(body).alias("text"),
        )

    return F.transform(_pieces(rendered), turn)


def _turns_of(rendered: Column, role: str) -> Column:
    """array<struct<n,opener,wanted,body>>: what stands between closers, its length and its opener's, and whether loss is on its body."""
    opened = r"\A### ([^\n:]*): "
    return F.transform(
        F.split(F.regexp_replace(rendered, r"\A<chat \d>\n", ""), r"</turn>\n"),
        lambda p: F.struct(
            F.length(p).alias("n"),
            F.length(F.regexp_extract(p, opened, 0)).alias("opener"),
            ((_unescape_role(F.regexp_extract(p, opened, 1)) == role) & p.rlike(opened)).alias("wanted"),
            F.regexp_replace(p, opened, "").alias("body"),
        ),
    )


def _spans(pieces: Column) -> Column:
    """array<struct<start,length>>, in code points of the formatted text. Pieces are summed in blocks and the blocks then
    moved to their places: no array grows by one element for each turn, so the time is in proportion to the turns."""
    block = lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / BLOCK).cast("int")), block)
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, p: Column) -> Column:
        own = F.array(F.struct((acc["at"] + p["opener"]).alias("start"), (p["n"] - p["opener"]).alias("length")))
        return F.struct((acc["at"] + p["n"] + len(CLOSER) + 1).alias("at"), F.when(p["wanted"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    local = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    head = F.struct(F.lit(len("<chat 0>\n")).alias("at"), F.array().cast("array<int>").alias("starts"))
    places = lambda sums: F.aggregate(sums, head, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
    moved = lambda sums: F.flatten(F.zip_with(sums, places(sums), lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))))
    return F.get(F.transform(F.array(local), moved), F.lit(0))  # named once, used twice


def loss_spans(rendered: Column, role: str = "assistant") -> Column:
    """array<struct<start,length>>, in code points of the formatted text: the bodies of that role's turns."""
    return F.get(F.transform(F.array(_turns_of(rendered, role)), _spans), F.lit(0))


def under_loss(rendered: Column, role: str = "assistant") -> Column:
    """All text under those spans, unescaped, in order and nothing between: cut from the formatted text turn by turn."""
    escaped = ~rendered.startswith("<chat 0>")
    learned = F.filter(_turns_of(rendered, role), lambda p: p["wanted"])
    return F.concat_ws("", F.transform(learned, lambda p: F.when(escaped, _unescape(p["body"])).otherwise(p["body"])))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, level, turns (as parsed back), loss_spans. One shuffle, by conv_id; the round trip is checked in the plan."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    grouped = (
        rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
        .groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    )
    tried = grouped.withColumn("formatted", _render(F.col("source"), 0)).withColumn("turns", parse(F.col("formatted")))
    for level in range(1, LEVELS):
        same = F.col("turns") == F.col("source")
        tried = tried.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(_render(F.col("source"), level))).withColumn(
            "turns", F.when(same, F.col("turns")).otherwise(parse(F.col("formatted")))
        )
    proved = F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return tried.withColumn("formatted", proved).select(
        "conv_id", "formatted", F.substring("formatted", 7, 1).cast("int").alias("level"), "turns", loss_spans(F.col("formatted")).alias("loss_spans")
    )


def digest(chats: DataFrame) -> DataFrame:
    """What the contract of op1 asks for, read back from the formatted text."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = under_loss(F.col("formatted"))
    return chats.withColumn("learned", learned).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
