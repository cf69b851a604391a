"""Text picture of an interaction, with flanks shortened and end positions on rulers, as columns.

Defined results: a null in any of the six texts, or a position that is no whole number, gives a null picture; a line without a
word has empty flanks; white space around lines counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pair_line

#: Where the bases of the interaction start, the longest flank shown whole, what stands in for a part left out.
LEFT, FLANK, GAP = 14, 11, "..."


def _spaces(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(n, F.lit(0)))


def _flanks(line: Column) -> tuple[Column, Column, Column]:
    """First word, what stands between, last word (empty where there is one word only)."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    left = F.regexp_extract(line, r"^\S+", 0)
    right = F.regexp_extract(line, r"\s(\S+)$", 1)
    return left, F.substring(line, F.length(left) + 1, F.length(line) - F.length(left) - F.length(right)), right


def _shortened(flank: Column, first: int, last: int) -> Column:
    return F.concat(F.substring(flank, 1, first), F.lit(GAP), F.substring(flank, -last, last))


def _left(flank: Column) -> Column:
    return F.when(F.length(flank) > FLANK, _shortened(flank, 6, 5)).otherwise(F.lpad(flank, LEFT, " "))


def _right(flank: Column) -> Column:
    return F.when(F.length(flank) > FLANK, _shortened(flank, 5, 6)).otherwise(flank)


def _ends(positions: Column) -> tuple[Column, Column]:
    number = lambda pattern: F.regexp_extract(positions, pattern, 1).try_cast("int")
    return number(r"^\s*(\S+)"), number(r"(\S+)\s*$")


def _ruler(width: Column, bare_left: Column, bare_right: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """Line of positions and line of ticks; a bare end has no base beyond the interaction."""
    pad, bare, text = _spaces(bare_left + (LEFT - 1)), bare_left + bare_right, left.cast("string")
    tick = F.lit("|")
    return F.concat(pad, text, _spaces(width - F.length(text) - bare + 1), right.cast("string")), F.concat(pad, tick, _spaces(width - bare), tick)


def picture(line1: Column, line2: Column, line3: Column, line4: Column, target: Column, query: Column) -> Column:
    """Nine lines, each ended by a literal backslash-n, spaces as underscores.

    ``line1`` to ``line4`` are the target's flanks, the two paired strands and the query's flanks; ``target`` and ``query`` the
    positions ("first -- last") of the interaction.
    """
    upper, lower = F.trim(line2), F.trim(line3)
    a, above, b = _flanks(line1)
    c, below, d = _flanks(line4)
    bare = lambda x: (F.length(x) == 3).cast("int")  # noqa: E731  nothing but the strand's end mark
    (t0, t1), (q0, q1) = _ends(target), _ends(query)
    top = _ruler(F.length(upper), bare(a), bare(b), t0 - 1 + bare(a), t1 + 1 - bare(b))
    low = _ruler(F.length(lower), bare(c), bare(d), q1 + 1 - bare(c), q0 - 1 + bare(d))
    indent = _spaces(F.length(_left(a)))
    lines = [
        *top, F.concat(_left(a), above, _right(b)), F.concat(indent, upper), F.concat(indent, pair_line(upper, lower)), F.concat(indent, lower),
        F.concat(_left(c), below, _right(d)), low[1], low[0],
    ]
    return F.translate(F.concat(*[x for line in lines for x in (line, F.lit("\\n"))]), " ", "_")
