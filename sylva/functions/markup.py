"""Marked-up texts as arrays of pieces: maths in dollars, emphasis in stars and underscores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maths on a line of its own or within one, and strong or plain emphasis.
MATHS = r"\$\$([\s\S]+?)\$\$|(?<!\\)\$([^$\n]+?)(?<!\\)\$"
EMPHASIS = r"(?s)\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_"


def _pieces(text: Column, pattern: str, plain, marked) -> Column:
    """What ``plain`` makes of the text between matches and ``marked`` of each match, in order, without empty plain text."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    both = F.flatten(F.transform(zipped, lambda x: F.array(F.when(x["p"] != "", plain(x["p"])), F.when(x["m"].isNotNull(), marked(x["m"])))))
    return F.array_compact(both)


def split_maths(text: Column) -> Column:
    """array of (kind, value): text as it stands, inline and display maths without dollars and outer space. An escaped dollar
    opens nothing. Null stays null; an empty text has no pieces."""
    piece = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    width = lambda m: F.when(F.startswith(m, F.lit("$$")), 2).otherwise(1)
    inner = lambda m: F.regexp_replace(F.substring(m, width(m) + 1, F.length(m) - 2 * width(m)), r"^\s+|\s+$", "")
    return _pieces(text, MATHS, lambda p: piece(F.lit("text"), p), lambda m: piece(F.when(width(m) == 2, "display").otherwise("inline"), inner(m)))


def emphasis_runs(text: Column) -> Column:
    """array of (text, bold, italic): runs of a text whose marks become style. Marks without a partner stay as text. Null
    stays null; an empty text has no runs."""
    run = lambda t, bold, italic: F.struct(t.alias("text"), bold.alias("bold"), italic.alias("italic"))
    strong = lambda m: F.rlike(m, F.lit(r"(?s)^(\*\*.+\*\*|__.+__)$"))
    width = lambda m: F.when(strong(m), 2).otherwise(1)
    return _pieces(text, EMPHASIS, lambda p: run(p, F.lit(False), F.lit(False)), lambda m: run(F.substring(m, width(m) + 1, F.length(m) - 2 * width(m)), strong(m), ~strong(m)))


#: Maths as typed for export, the commands that need groups behind them, and what a formula falls into.
TYPED_MATHS = r"(?s)\$\$(.+?)\$\$|\$([^$\n]+?)\$"
GROUPS = {r"\frac": 2, r"\sqrt": 1, r"\text": 1, r"\mathrm": 1, r"\bar": 1, r"\hat": 1, r"\vec": 1}
TOKENS = r"(?s)\\[A-Za-z]+|\\.|[{}^_]|[^\\{}^_\s]|\s+"


def well_formed(latex: Column) -> Column:
    """Whether a formula can be set: groups close in order, and every script and command has what it stands for.

    One fold over its tokens. The state is how many groups are open and what each of them still waits for: a script waits
    for one thing, a fraction for two, and a group or a sign that comes is one of them.
    """
    tokens = F.filter(F.regexp_extract_all(latex, F.lit(TOKENS), F.lit(0)), lambda t: F.trim(F.translate(t, "\n\t\r", "   ")) != "")
    needs = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    zero = F.struct(F.array(F.lit(0)).alias("open"), F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        waits, rest = s["open"][0], F.slice(s["open"], F.lit(2), F.lit(1 << 20))
        got = F.greatest(waits - 1, F.lit(0))
        more = F.coalesce(F.element_at(needs, t), F.when(t.isin("^", "_"), 1), F.lit(0))
        opened = F.concat(F.array(F.lit(0)), F.array(got), rest)  # the group that opens is what was waited for
        closed = F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit(0)))
        script_waits = t.isin("^", "_") & (waits > 0)
        return F.struct(
            F.when(t == "{", opened).when(t == "}", closed).otherwise(F.concat(F.array(got + more), rest)).alias("open"),
            (s["ok"] & ~((t == "}") & ((waits > 0) | (F.size(rest) == 0))) & ~script_waits).alias("ok"),
        )

    return F.aggregate(tokens, zero, step, lambda s: s["ok"] & (F.size(s["open"]) == 1) & (s["open"][0] == 0))


def typed_maths(text: Column) -> Column:
    """A text as pieces (kind, value) for export: ``maths`` where a formula was typed that can be set, ``text`` for all else; a
    formula that cannot be set stays as it was typed. A text without such a formula is one piece, a null text has none."""
    marked = F.regexp_extract_all(text, F.lit(TYPED_MATHS), F.lit(0))
    between = F.split(text, TYPED_MATHS, -1)
    piece = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    latex = lambda m: F.when(F.startswith(m, F.lit("$$")) & (F.length(m) > 4), F.substr(m, F.lit(3), F.length(m) - 4)).otherwise(F.substr(m, F.lit(2), F.length(m) - 2))
    said = F.transform(marked, lambda m: F.when(well_formed(latex(m)), piece("maths", latex(m))).otherwise(piece("text", m)))
    pairs = F.zip_with(between, said, lambda b, m: F.array(piece("text", b), m))
    return F.filter(F.flatten(F.transform(pairs, lambda p: F.filter(p, lambda x: x.isNotNull()))), lambda x: x["value"] != "")
