"""Chat formatting in budgeted, turn-aligned windows.

The tokens of a conversation's turns are summed from its start. The sums are cut
into strides; turns that lie within one stride make a window, and a turn that
runs over a cut makes one of its own, so windows follow from the sums alone and
no turn is split. A window holds, in order: the conversation's system turn, the
turns before it that fit into ``history`` tokens, and its own turns. Repeated
turns are context: only the window's own assistant turns are under the loss, so
every target counts once. A window keeps to the budget unless a single turn, or
the system turn, is larger than what the budget leaves for it.

Everything is DataFrame functions. Sums are taken first over runs of ``RUN``
turn numbers, then within each, and history is an equal join on stretches of the
sums, so a conversation that holds many rows is many small groups.

A turn is written as ``<|role|>``, a line break, the text, ``<|end|>`` and a line
break. Control strings inside roles and texts are replaced by a backslash and a
digit, the backslash itself as well, which can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classweave.llm.decontaminate import UNSPACED
from classweave.session import materialise

BUDGET = 512
HISTORY = 128
LEAST_STRIDE = 64
TURN_TOKENS = 4  # what the marks about a turn count as
RUN = 256

# Strings that templates use, each with its escape. The backslash
# is escaped first and restored last; a line break matters in roles only.
BACKSLASH = ("\\", "\\0")
CONTROLS = (
    ("<|", "\\1"), ("|>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4"),
    ("<s>", "\\5"), ("</s>", "\\6"), ("<<SYS>>", "\\7"), ("<</SYS>>", "\\8"))
LINE_BREAK = ("\n", "\\9")
END = "<|end|>\n"
# what counts as a token where none are counted: a character of a script without
# spaces, or up to so many others without white space
PIECE_CHARS = 8
WORD = f"[{UNSPACED}]|[^ \\t\\n\\r{UNSPACED}]{{1,{PIECE_CHARS}}}"

SPAN_TYPE = "array<struct<start:int,length:int>>"


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in (BACKSLASH, *CONTROLS, *([LINE_BREAK] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (LINE_BREAK, *CONTROLS, BACKSLASH):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def with_sums(turns: DataFrame, tokens: str | None = None) -> DataFrame:
    """Rows with the tokens before (``a``) and up to (``e``) each, and the head.

    ``tokens`` names a column that counts them; null there, or no such column,
    counts pieces of the text. A turn's marks count as ``TURN_TOKENS``.

    Turns are ordered by ``turn``, ``role`` and ``text``, nulls first; null roles
    and texts are empty. ``c, no_id`` stand for conv_id, null included. ``head``
    is the conversation's first turn.
    """
    rows = turns.select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("c"),
        F.col("conv_id").isNull().alias("no_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.when(F.col(tokens).isNotNull(), F.greatest(F.col(tokens).cast("long"), F.lit(0)))
         if tokens else F.lit(None).cast("long")).alias("counted")).withColumn(
        "cost", F.coalesce("counted", F.regexp_count("text", F.lit(WORD))).cast("long")
        + TURN_TOKENS).drop("counted").withColumn(
        "run", F.floor(F.col("turn") / RUN))
    keys = ["c", "no_id"]
    in_order = ["turn", "role", "text"]
    runs = rows.groupBy(*keys, "run").agg(
        F.sum("cost").alias("total"),
        F.min(F.struct(*in_order, "cost")).alias("first"))
    over = Window.partitionBy(*keys).orderBy("run")
    runs = runs.select(
        *keys, F.coalesce("run", F.lit(0)).alias("run"), F.col("run").isNull().alias("no_turn"),
        F.coalesce(F.sum("total").over(over.rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first("first").over(over).alias("head"))
    rows = rows.withColumn("no_turn", F.col("run").isNull()).withColumn(
        "run", F.coalesce("run", F.lit(0)))
    within = Window.partitionBy(*keys, "run", "no_turn").orderBy(*in_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.join(runs, [*keys, "run", "no_turn"]).withColumn(
        "e", F.col("before") + F.sum("cost").over(within)).withColumn(
        "a", F.col("e") - F.col("cost")).drop("before", "run", "no_turn", "turn")


def segment(role: Column, text: Column) -> Column:
    """One turn as it is written, with its escaped text's place and length."""
    shown, own = escape(role, role=True), escape(text)
    mark = F.concat(F.lit("<|"), shown, F.lit("|>\n"))
    return F.struct(
        F.concat(mark, own, F.lit(END)).alias("written"),
        F.length(mark).alias("start"), F.length(own).alias("length"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                   tokens: str | None = None) -> DataFrame:
    """``conv_id, window, text, n_turns, n_repeated, loss_spans`` of all windows.

    ``text`` starts with ``n_repeated`` turns met before, then ``n_turns`` own
    ones. ``loss_spans`` are places in ``text``, in code points, of the own
    assistant texts. Windows are numbered in order, not without gaps. Reads
    ``conv_id, turn, role, text``; repeated rows are turns like any other; a null
    conv_id is one conversation. An empty table gives no windows. ``tokens`` names a
    column with the tokens of each text, else pieces of the texts are counted.
    """
    if not 0 < history < budget:
        raise ValueError("history must be positive and below the budget")
    rows = with_sums(turns, tokens)
    system = F.when(F.col("head.role") == "system", F.col("head.cost")).otherwise(0)
    stride = F.greatest(F.lit(budget - history) - system, F.lit(LEAST_STRIDE))
    # cells of a turn's ends: equal within a stride, and rising from turn to turn
    rows = materialise(rows.withColumn("stride", stride).withColumn(
        "window", (F.floor(F.col("a") / F.col("stride")) + F.floor(
            (F.col("e") - 1) / F.col("stride"))).cast("long")).drop("stride"))
    starts = rows.groupBy("c", "no_id", "window").agg(
        F.min("a").alias("s"), F.min("head").alias("head"))
    bucket = F.floor(F.col("a") / history)
    before = rows.select(
        "c", "no_id", "a", "role", "text",
        F.explode(F.array(bucket, bucket + 1)).alias("bucket")).join(
        starts.select("c", "no_id", F.col("window"), "s",
                      F.floor(F.col("s") / history).alias("bucket")),
        ["c", "no_id", "bucket"]).where(
        (F.col("a") < F.col("s")) & (F.col("s") - F.col("a") <= history))
    # the system turn, where the window neither holds it nor repeats it as history
    heads = starts.where((F.col("head.role") == "system") & (F.col("s") > history))
    order = ["own", "a", "role", "segment"]
    parts = rows.select(
        "c", "no_id", "window", F.lit(1).alias("own"), "a", "role",
        segment(F.col("role"), F.col("text")).alias("segment")
    ).unionByName(before.select(
        "c", "no_id", "window", F.lit(0).alias("own"), "a", "role",
        segment(F.col("role"), F.col("text")).alias("segment"))
    ).unionByName(heads.select(
        "c", "no_id", "window", F.lit(0).alias("own"), F.lit(-1).cast("long").alias("a"),
        F.col("head.role").alias("role"),
        segment(F.col("head.role"), F.col("head.text")).alias("segment")))
    windows = parts.groupBy("c", "no_id", "window").agg(
        F.sort_array(F.collect_list(F.struct(*order))).alias("parts"),
        F.sum("own").alias("n_turns"))

    def step(state: Column, part: Column) -> Column:
        target = (part["own"] == 1) & (part["role"] == "assistant")
        span = F.struct((state["at"] + part["segment"]["start"]).alias("start"),
                        part["segment"]["length"].alias("length"))
        return F.struct(
            (state["at"] + F.length(part["segment"]["written"])).alias("at"),
            F.when(target, F.concat(state["spans"], F.array(span))).otherwise(
                state["spans"]).alias("spans"))

    folded = F.aggregate("parts", F.struct(
        F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("spans")), step)
    return windows.select(
        F.when(~F.col("no_id"), F.col("c")).alias("conv_id"), "window",
        F.array_join(F.transform("parts", lambda p: p["segment"]["written"]), "").alias("text"),
        "n_turns", (F.size("parts") - F.col("n_turns")).alias("n_repeated"),
        folded["spans"].alias("loss_spans"))


def read_turns(text: Column, n_repeated: Column) -> Column:
    """The own turns of a window, from its text: an array of (role, text)."""
    whole = F.split(text, "<\\|end\\|>\n")
    own = F.slice(whole, n_repeated.cast("int") + 1,
                  F.size(whole) - 1 - n_repeated.cast("int"))
    return F.transform(own, lambda turn: F.struct(
        unescape(F.substring_index(F.substring(turn, 3, 2**31 - 1), "|>\n", 1)).alias("role"),
        unescape(F.substring(turn, F.instr(turn, "|>\n") + 3, 2**31 - 1)).alias("text")))


def read_targets(text: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, from the window's text."""
    return F.transform(loss_spans, lambda span: unescape(F.substring(
        text, span["start"] + 1, span["length"])))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone, what they hold.

    ``turns_sha256`` is over role, line break, text, line break of all turns;
    ``loss_sha256`` over all texts under the loss. The digest needs a
    conversation's text as one string.
    """
    read = windows.select(
        "conv_id", "window", F.length("text").cast("long").alias("chars"),
        read_turns(F.col("text"), F.col("n_repeated")).alias("turns"),
        F.array_join(read_targets(F.col("text"), F.col("loss_spans")), "").alias("loss"))
    line = F.lit("\n")
    read = read.select(
        "conv_id", "window", "chars", "loss", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], line, t["text"], line)), "").alias("turns"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda w: w["turns"]), ""), 256)
        .alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def digest_sql(source: str, budget: int = BUDGET, history: int = HISTORY) -> str:
    """The digests in SQL over ``source`` (conv_id, turn, role, text)."""
    def coded(text: str, pairs: tuple) -> str:
        for plain, code in pairs:
            plain = "chr(10)" if plain == "\n" else f"'{plain}'"
            text = f"replace({text}, {plain}, '{code}')"
        return text

    own = coded("text", (BACKSLASH, *CONTROLS))
    shown = coded("role", (BACKSLASH, *CONTROLS, LINE_BREAK))
    marks = len("<|") + len("|>\n") + len(END)
    nulls = "turn NULLS FIRST, role, text"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role,
                      coalesce(text, '') AS text FROM ({source})),
    k AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + {TURN_TOKENS} AS cost,
                 length({shown}) + length({own}) + {marks} AS chars FROM t),
    p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY {nulls}
                                    ROWS UNBOUNDED PRECEDING) AS e,
                 first(role) OVER (PARTITION BY conv_id ORDER BY {nulls}) = 'system' AS sys,
                 first(cost) OVER (PARTITION BY conv_id ORDER BY {nulls}) AS sys_cost,
                 first(chars) OVER (PARTITION BY conv_id ORDER BY {nulls}) AS sys_chars
          FROM k),
    w AS (SELECT *, e - cost AS a,
                 greatest({budget - history} - CASE WHEN sys THEN sys_cost ELSE 0 END,
                          {LEAST_STRIDE}) AS stride FROM p),
    x AS (SELECT *, a // stride + (e - 1) // stride AS win FROM w),
    s AS (SELECT conv_id, win, min(a) AS s, any_value(sys) AS sys,
                 any_value(sys_chars) AS sys_chars FROM x GROUP BY ALL),
    repeated AS (
        SELECT s.conv_id, sum(x.chars) AS chars FROM s JOIN x
        ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND x.a < s.s
           AND s.s - x.a <= {history} GROUP BY ALL),
    heads AS (SELECT conv_id, sum(sys_chars) AS chars FROM s
              WHERE sys AND s > {history} GROUP BY ALL),
    whole AS (
        SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
               sha256(string_agg(role || chr(10) || text || chr(10), ''
                                 ORDER BY {nulls})) AS turns_sha256,
               coalesce(string_agg(text, '' ORDER BY {nulls})
                        FILTER (role = 'assistant'), '') AS loss
        FROM t JOIN (SELECT DISTINCT role, text, chars FROM k) USING (role, text)
        GROUP BY conv_id)
    SELECT whole.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars,
           sha256(loss) AS loss_sha256,
           (whole.chars + coalesce(repeated.chars, 0)
            + coalesce(heads.chars, 0))::BIGINT AS formatted_chars
    FROM whole
    LEFT JOIN repeated ON whole.conv_id IS NOT DISTINCT FROM repeated.conv_id
    LEFT JOIN heads ON whole.conv_id IS NOT DISTINCT FROM heads.conv_id
    """
