"""Sequences, packed cells and labels as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_FIELDS = ["locus", "gene", "energy", "p", "start1", "end1", "start2", "end2", "gene_id"]


def reverse_complement(seq: Column) -> Column:
    """Case is kept, letters other than acgt stay."""
    return F.reverse(F.translate(seq, "gatcGATC", "ctagCTAG"))


def spliced(seq: Column, parts: Column) -> Column:
    """Concatenation of the 1-based inclusive (s, e) parts of a sequence."""
    return F.array_join(F.transform(parts, lambda x: seq.substr(x["s"], x["e"] - x["s"] + 1)), "")


def pack_cell(locus, gene, energy, p, s1, e1, s2, e2, gene_id) -> Column:
    """locus(gene|energy|p|start1|end1|start2|end2|GeneID:id); null when there is no locus."""
    body = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("N/A")) for x in (gene, energy, p, s1, e1, s2, e2)])
    return F.when(locus.isNotNull(), F.concat(locus, F.lit("("), body, F.lit("|GeneID:"), F.coalesce(gene_id.cast("string"), F.lit("N/A")), F.lit(")")))


def unpack_cell(cell: Column) -> Column:
    """Struct of a packed cell's fields; null for a null or empty cell."""
    x = F.split(cell, r"[(|)]")
    num = {"energy": "double", "p": "double", "start1": "int", "end1": "int", "start2": "int", "end2": "int"}
    get = lambda i: F.get(x, F.lit(i))
    fields = [(get(i).try_cast(num[f]) if f in num else get(i)).alias(f) for i, f in enumerate(CELL_FIELDS[:8])]
    gene_id = F.regexp_extract(cell, r"GeneID:([^)|]*)", 1).alias("gene_id")
    return F.when(F.coalesce(cell, F.lit("")) != "", F.struct(*fields, gene_id))


def characters(s: Column) -> Column:
    """Array of a text's characters, cut in one pass."""
    return F.slice(F.split(s, ""), F.lit(1), F.length(s))


def pair_line(a: Column, b: Column) -> Column:
    """One character a pair of bases: | for AU and GC, : for GU, else a space."""
    pair = F.zip_with(characters(F.translate(a, "acgu", "ACGU")), characters(F.translate(b, "acgu", "ACGU")), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    mark = lambda p: F.when(p.isin("AU", "UA", "GC", "CG"), "|").when(p.isin("GU", "UG"), ":").otherwise(" ")
    return F.array_join(F.transform(pair, mark), "")


def abbreviate(name: Column) -> Column:
    """Gen_species[_strain] of Genus_species_strain."""
    parts = F.split(name, "_")
    return F.concat_ws("_", F.substring(F.get(parts, F.lit(0)), 1, 3), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


def annotation(product: Column, note: Column, function: Column, drop: str = ",") -> Column:
    """The product unless hypothetical, else the note, else the function; the characters of ``drop`` become spaces."""
    known = F.when(~product.contains("hypothetical protein"), product)
    return F.translate(F.coalesce(known, note, function), drop, " " * len(drop))


def gene_name(name: Column) -> Column:
    return F.translate(name, "(),", "")


def organism_code(rank: Column) -> Column:
    """Four letters for a number from 1, different for each up to 26^4."""
    k = rank - 1
    return F.concat(*[F.char((F.floor(k / 26**i) % 26 + 97).cast("int")) for i in (3, 2, 1, 0)])


def p_bin(p: Column, last: float = 0.3) -> Column:
    """Colour class 1 to 6 of a p-value; null stays null."""
    return F.when(p.isNull(), None).when(p <= 0.001, 1).when(p <= 0.01, 2).when(p <= 0.1, 3).when(p <= 0.2, 4).when(p <= last, 5).otherwise(6)


def conservation_state(mrna: Column, srna1: Column, srna2: Column) -> Column:
    """3 both sites, 1 only the target's, 2 only the query's, 0 none; null without data."""
    either = srna1 | srna2
    return F.when(mrna.isNull(), None).when(mrna & either, 3).when(mrna, 1).when(either, 2).otherwise(0)


def rescued_state(opt: Column, sub: Column) -> Column:
    """A best hit without the target's site takes the second-best's: state 3 becomes 5, state 1 becomes 4."""
    lacks = opt.isin(0, 2)
    return F.when(lacks & (sub == 3), 5).when(lacks & (sub == 1), 4).otherwise(opt)


def state_label(state: Column) -> Column:
    return F.when(state == 2, "-/+").when(state == 1, "+/-").when(state == 0, "-/-").when(state == 4, "2+/-").when(state == 5, "2").otherwise("")


def ungapped_positions(aligned: Column) -> Column:
    """Aligned position (from 1) of each base of a gapped sequence."""
    return F.array_compact(F.transform(characters(aligned), lambda c, i: F.when(c != "-", i + 1)))


def aligned_position(aligned: Column, pos: Column) -> Column:
    return F.get(ungapped_positions(aligned), pos - 1)


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common positions of two inclusive intervals, as a share of the shorter one."""
    common = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return common / F.least(e1 - s1 + 1, e2 - s2 + 1)


def hue(group: Column, groups: Column) -> Column:
    return group * 360.0 / groups


def saturation(p: Column) -> Column:
    return F.when(p <= 1e-6, 1.0).otherwise(-0.15 * F.log10(p))


def hsv_hex(h: Column, s: Column) -> Column:
    """#rrggbb of hue (0 to 360) and saturation at full value."""
    k = F.floor(h / 60).cast("int")
    f = h / 60 - k
    byte = lambda x: F.lpad(F.lower(F.hex(F.floor(x * 255).cast("long"))), 2, "0")
    v, p, q, t = F.lit("ff"), byte(1 - s), byte(1 - s * f), byte(1 - s * (1 - f))
    order = {0: (v, t, p), 1: (q, v, p), 2: (p, v, t), 3: (p, q, v), 4: (t, p, v), 5: (v, p, q)}
    out = None
    for i, (r, g, b) in order.items():
        c = F.concat(F.lit("#"), r, g, b)
        out = F.when(k % 6 == i, c) if out is None else out.when(k % 6 == i, c)
    return out


def region_window(seq: Column, circular: Column, strand: Column, pos: Column, up: int, down: int, least: int = 150) -> Column:
    """The window around ``pos`` on its strand: ``up`` bases before it and ``down`` from it on.

    Beyond an end a circular sequence goes on at its other end; a linear one is cut, and null below ``least`` bases. A
    sequence shorter than the window has none.
    """
    n = F.length(seq)
    first = F.when(strand == 1, pos - up).otherwise(pos - down + 1)
    last = first + (up + down - 1)
    take = lambda a, b: F.when(b >= a, seq.substr(a, b - a + 1)).otherwise("")
    inner = take(F.greatest(first, F.lit(1)), F.least(last, n))
    before = F.when(first < 1, take(n + first, n)).otherwise("")
    after = F.when(last > n, take(F.lit(1), last - n)).otherwise("")
    whole = F.when(circular, F.concat(before, inner, after)).otherwise(inner)
    out = F.when(strand == 1, whole).otherwise(reverse_complement(whole))
    cut = (first < 1) | (last > n)
    return F.when((n < up + down) | (~circular & cut & (F.length(inner) < least)), None).otherwise(out)


def window_anchor(region: str, strand: Column, start: Column, end: Column) -> Column:
    """Where the window of a coding sequence is placed: its start for 5utr, the base after its end for 3utr."""
    if region == "5utr":
        return F.when(strand == 1, start).otherwise(end)
    if region == "3utr":
        return F.when(strand == 1, end + 1).otherwise(start - 1)
    raise ValueError(f"no anchor in region {region}")


def cds_with_flanks(seq: Column, circular: Column, strand: Column, parts: Column, up: int, down: int) -> Column:
    """Spliced coding sequence between its flanks; flanks are cut at the ends of a linear sequence."""
    first, last = F.array_min(F.transform(parts, lambda x: x["s"])), F.array_max(F.transform(parts, lambda x: x["e"]))
    left, right = F.when(strand == 1, up).otherwise(down), F.when(strand == 1, down).otherwise(up)
    n, body = F.length(seq), spliced(seq, parts)
    a, b = first - left, last + right
    take = lambda x, y: F.when(y >= x, seq.substr(x, y - x + 1)).otherwise("")
    lead = F.concat(F.when(circular & (a < 1), take(n + a, n)).otherwise(""), take(F.greatest(a, F.lit(1)), first - 1))
    trail = F.concat(take(last + 1, F.least(b, n)), F.when(circular & (b > n), take(F.lit(1), b - n)).otherwise(""))
    out = F.concat(lead, body, trail)
    return F.when(strand == 1, out).otherwise(reverse_complement(out))


def date_stamp(time: Column, form: str = "yyyy-MM-dd") -> Column:
    """The day of a time, as it is put into file names."""
    return F.date_format(time, form)
