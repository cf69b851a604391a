"""Run options, their checks, and option files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunOptions:
    """Options of a run; names and defaults are those of the command line."""

    srnaseq: str = "input_sRNA.fa"
    region: str = "5utr"
    ntup: int = 200
    ntdown: int = 100
    winsize: int = 150
    maxbpdist: int = 100
    rcsize: float = 0.5
    cores: int = 1
    cop1: bool = False
    cons: int = 0
    nooi: bool = False
    ooifilt: float = 0.0
    root: float = 1.0
    topcount: int = 200
    enrich: int = 0
    websrv: bool = False
    noclean: bool = False
    verbose: bool = False

    def __post_init__(self):
        bad = []
        if self.region not in ("5utr", "3utr", "cds"):
            bad.append("region is 5utr, 3utr or cds")
        if self.region != "cds" and self.ntup + self.ntdown < self.winsize:
            bad.append("ntup + ntdown is less than winsize")
        if self.maxbpdist > self.winsize:
            bad.append("maxbpdist is greater than winsize")
        if not 0 <= self.rcsize <= 1:
            bad.append("rcsize is between 0 and 1")
        if not 0 <= self.ooifilt <= 1:
            bad.append("ooifilt is between 0 and 1")
        if self.cons not in (0, 1, 2):
            bad.append("cons is 0, 1 or 2")
        if self.cons == 1 and self.nooi:
            bad.append("cons 1 needs an organism of interest")
        if self.cop1 and self.cons:
            bad.append("cop1 works without cons only")
        if bad:
            raise ValueError("; ".join(bad))
        if self.cores < 1:
            object.__setattr__(self, "cores", 1)

    @classmethod
    def parse(cls, text: str) -> RunOptions:
        """From name:value lines, in any order; unknown names are an error."""
        kinds, out = {f.name: f.type for f in fields(cls)}, {}
        for line in text.splitlines():
            name, sep, value = line.strip().partition(":")
            if not sep:
                continue
            if name not in kinds:
                raise ValueError(f"no option {name}")
            out[name] = value in ("1", "true", "True") if kinds[name] == "bool" else {"int": int, "float": float}.get(kinds[name], str)(value)
        return cls(**out)

    def text(self) -> str:
        return "".join(f"{f.name}:{getattr(self, f.name)}\n" for f in fields(self))


def check_input(seqs: DataFrame, known: DataFrame | None = None) -> list[str]:
    """What is wrong with the query sequences (id, seq): one aggregate row reaches the driver."""
    ok = F.col("id").rlike(r"NC_\d{6}|NZ_.*")
    row = seqs.agg(
        F.count("*").alias("n"), F.count_if(F.contains("seq", F.lit("-"))).alias("gaps"), F.count_if(~ok).alias("names"),
        (F.count("*") - F.count_distinct("id")).alias("double"),
    ).first()
    out = []
    if row["n"] < 3:
        out.append("fewer than three sequences")
    if row["gaps"]:
        out.append("gaps in sequences")
    if row["names"]:
        out.append("ids that are no RefSeq ids")
    if row["double"]:
        out.append("ids that occur twice")
    if known is not None and not seqs.join(known.select(F.col("replicon").alias("id")), "id", "left_anti").isEmpty():
        out.append("ids that aren't available")
    return out


def choose_mode(options: RunOptions) -> str:
    """The result that a run returns first."""
    if options.cop1:
        return "v1"
    if options.cons == 1:
        return "ooi_ooiconsensus"
    if options.cons == 2:
        return "balanced_consensus" if options.nooi else "ooi_consensus"
    return "balanced" if options.nooi else "ooi"


#: What must not hold of a run's options, as conditions on their columns.
BROKEN = {
    "region is 5utr, 3utr or cds": "region NOT IN ('5utr', '3utr', 'cds')",
    "ntup + ntdown is less than winsize": "region <> 'cds' AND ntup + ntdown < winsize",
    "maxbpdist is greater than winsize": "maxbpdist > winsize",
    "rcsize is between 0 and 1": "NOT rcsize BETWEEN 0 AND 1",
    "ooifilt is between 0 and 1": "NOT ooifilt BETWEEN 0 AND 1",
    "cons is 0, 1 or 2": "cons NOT IN (0, 1, 2)",
    "cons 1 needs an organism of interest": "cons = 1 AND nooi",
    "cop1 works without cons only": "cop1 AND cons > 0",
}
#: ``choose_mode`` over columns.
MODE = """CASE WHEN cop1 THEN 'v1' WHEN cons = 1 THEN 'ooi_ooiconsensus' WHEN cons = 2 THEN if(nooi, 'balanced_consensus', 'ooi_consensus') ELSE if(nooi, 'balanced', 'ooi') END"""


def options_table(lines: DataFrame) -> DataFrame:
    """A row per run from (file, line_no, value) of name:value lines: every option with its type (defaults where none is given), mode, broken and unknown.

    A srnaseq line opens the next run of a file, so the files of many runs may be one. Of repeated names of a run the last line counts; values that don't
    read as their type count as not given and are named in unknown, as are names that are no options. Lines without a colon are left out.
    """
    from ..operators.ranking import segmented

    named = lines.where(F.contains("value", F.lit(":"))).select("file", "line_no", F.trim(F.substring_index("value", ":", 1)).alias("name"), F.trim(F.regexp_replace("value", "^[^:]*:", "")).alias("given"))
    runs = segmented(named, ["file"], ["line_no"], run=("sum", (F.col("name") == "srnaseq").cast("int")))
    kinds = {f.name: {"str": "string", "bool": "boolean"}.get(f.type, f.type) for f in fields(RunOptions)}
    last = {k: F.max_by(F.when(F.col("name") == k, F.col("given")), F.when(F.col("name") == k, F.col("line_no"))) for k in kinds}
    known = F.col("name").isin(*kinds)
    table = runs.groupBy("file", "run").agg(*[c.alias(f"__{k}") for k, c in last.items()], F.array_sort(F.collect_set(F.when(~known, F.col("name")))).alias("__odd"))
    typed = {f.name: F.col(f"__{f.name}").try_cast(kinds[f.name]) for f in fields(RunOptions)}
    unread = F.array_compact(F.array(*[F.when(F.col(f"__{k}").isNotNull() & c.isNull(), F.lit(k)) for k, c in typed.items()]))
    out = table.select("file", "run", *[F.coalesce(typed[f.name], F.lit(f.default)).alias(f.name) for f in fields(RunOptions)], F.array_join(F.concat("__odd", unread), "; ").alias("unknown"))
    broken = F.array_join(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(text)) for text, rule in BROKEN.items()])), "; ")
    return out.withColumn("cores", F.greatest("cores", F.lit(1))).withColumns({"mode": F.expr(MODE), "broken": broken})
