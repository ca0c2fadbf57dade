"""Rules: which strings, parts and objects indicate what (families I, V, X, E, O, D)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.lens import any_of
from doclens.operators.held import held_labels


@dataclass(frozen=True)
class Rule:
    """A rule holds for a value that has one of includes (or matches regex) and none of excludes."""

    rule_id: str
    severity: str
    indication: str
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    regex: str | None = None
    max_len: int | None = None

    @property
    def family(self) -> str:
        return self.rule_id.rstrip("0123456789")


# The words of each rule.
BENIGN = ["crl", "thawte", "verisign", "symantec", "ocsp", "openxml", "theme", "schema", "microsoft"]
SYSTEM = ["_rels", "java", "Java", "jvm", "mscoree.dll", "kernel32.dll", "gdiplus32.dll", "gdiplus.dll", "advapi32.dll", "native"]
PATHS = [".exe", ".EXE", ".sct", ".ocx", ".php", "ProgramData", "Desktop", "Downloads", "C:\\Users", ".com", ".hta", ".tmp", ".dat", ".txt"]
STRING_RULES = [
    Rule("I1", "low", "file download", ["URLMON", "urlmon", "loadToFile"]),
    Rule("I2", "medium", "URL", ["http:", "https:"], BENIGN),
    Rule("I3", "low", "file creation", ["CreateFile", "CreateDirectory"]),
    Rule("I4", "medium", "shell execution", ["ShellExecute", "Shell32.Shell", "cmd /c", "powershell"]),
    Rule("I5", "medium", "path or domain", PATHS, BENIGN + SYSTEM, r"[a-z]+\.[a-z]", 100),
    Rule("I6", "high", "executable payload", ["This program", "DOS mode"]),
    Rule("I7", "high", "equation string", regex="(?i)equation"),
]
MACRO_RULES = [
    Rule("V1", "high", "runs when opened", ["Auto_Open", "Document_Open"]),
    Rule("V2", "high", "runs when closed", ["Auto_Close"]),
    Rule("V3", "high", "shell in macro", ["Shell(", "WScript.Shell"]),
    Rule("V4", "high", "URL in macro", ["http"]),
    Rule("V5", "high", "compressed macro source", ["\x00Attribut\x00e "]),
    Rule("X1", "high", "macro sheet function", ["HALT()", "RETURN(", "EXEC()", "WRITE(", "FOR(", "FORMULA("]),
]
# The equation editor's class id as stored, and its program id.
EQUATION_CLSID = "\x02\xce\x02\x00\x00\x00\x00\x00\xc0\x00\x00\x00\x00\x00\x00\x46"
EQUATION_PROGID = "Microsoft Equation 3.0"
MIN_EQUATION_PART = 50


def holds(rule: Rule, value: Column) -> Column:
    """The rule compiled to one expression: no rows are multiplied to test it."""
    found = any_of(value, rule.includes)
    if rule.regex:
        found = found | F.coalesce(value.rlike(rule.regex), F.lit(False))
    if rule.excludes:
        found = found & ~any_of(value, rule.excludes)
    if rule.max_len is not None:
        found = found & F.coalesce(F.length(value) < rule.max_len, F.lit(False))
    return found


def _finding(rule_id: str, severity: str, indication: str, description: Column) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(indication).alias("indication"), description.alias("description")
    )


def exploded(df: DataFrame, keep: list[str], candidates: list[tuple[Column, Column]]) -> DataFrame:
    """A row of df for each (condition, finding) whose condition holds."""
    found = F.filter(F.array(*[F.when(c, f) for c, f in candidates]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


def apply_rules(strings: DataFrame, rules: list[Rule] = STRING_RULES, value: str = "value") -> DataFrame:
    """A finding for each string and rule that holds for it (F3 keeps strings of more than 8 characters)."""
    keep = [c for c in strings.columns if c not in (value, "kind")]
    v = F.col(value)
    return exploded(strings, keep, [(holds(r, v), _finding(r.rule_id, r.severity, r.indication, v)) for r in rules])


def match_rule_table(strings: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """J2 for rules in a table (rule_id, includes, excludes) of any size: (artifact_id, rule_id, description).

    Blocks of strings meet shards of rules, and each place of a string is looked up among the words
    of each length; only rule ids leave, and strings are repeated at the end. A string matches a
    rule once, whatever number of its words it holds.
    """
    # Every string holds an empty exclude word, and a null one tells nothing: neither rule matches.
    sound = rules.where("excludes is not null and not exists(excludes, x -> x is null or x = '')")
    words = sound.select(F.col("rule_id").alias("label"), F.coalesce("includes", F.array().cast("array<string>")).alias("includes"), "excludes")
    found = held_labels(strings.select("artifact_id", F.col(value).alias("t")), words)
    return found.select("artifact_id", F.explode("labels").alias("rule_id"), F.col("t").alias("description"))


def macro_url(value: Column) -> Column:
    """V4's description: the first quoted URL with a path, else what follows http."""
    quoted = F.regexp_extract(value, r'(https?://[^\n\r]*\.[^\n\r]*/[^\n\r]*")', 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(value, r'(http[^\s"]*)', 1))


def macro_findings(macros: DataFrame, value: str = "value") -> DataFrame:
    """V1 to V5 and X1 on macro text."""
    v = F.col(value)
    keep = [c for c in macros.columns if c != value]
    described = [(r, macro_url(v) if r.rule_id == "V4" else F.left(v, F.lit(100))) for r in MACRO_RULES]
    return exploded(macros, keep, [(holds(r, v), _finding(r.rule_id, r.severity, r.indication, d)) for r, d in described])


def only_attributes(value: Column) -> Column:
    """V6: every line that is not blank is an attribute or Option Explicit."""
    lines = F.split(F.replace(value, F.lit("\r"), F.lit("")), "\n")
    return F.forall(lines, lambda s: (F.trim(s) == "") | F.startswith(s, F.lit("Attribute ")) | (s == "Option Explicit"))


def strip_attributes(value: Column) -> Column:
    """V7: without the leading attribute lines."""
    return F.regexp_replace(value, r"^(?:Attribute VB_[^\n]+? = [^\n]+\n)+", "")


def equation_findings(parts: DataFrame) -> DataFrame:
    """Class id and program id of the equation editor in parts of more than 50 bytes (F2)."""
    t = F.col("t")
    clsid, progid = F.contains(t, F.lit(EQUATION_CLSID)), F.contains(t, F.lit(EQUATION_PROGID))
    rule = (
        F.when(clsid & progid, _finding("E1", "high", "equation editor class and program id", F.lit(EQUATION_PROGID)))
        .when(clsid, _finding("E2", "high", "equation editor class id", F.lit("class id")))
        .when(progid, _finding("E3", "info", "equation editor program id", F.lit(EQUATION_PROGID)))
    )
    return parts.where(F.length("t") > MIN_EQUATION_PART).select("artifact_id", rule.alias("f")).where("f is not null").select("artifact_id", "f.*")


ENCRYPTED_STREAMS = ["StrongEncryptionDataSpace", "Encryption", "EncryptedPackage"]


def encrypted_containers(parts: DataFrame) -> DataFrame:
    """A stream path with a component that names encryption."""
    names = F.split(F.replace("part_path", F.lit("\\"), F.lit("/")), "/")
    marked = F.arrays_overlap(names, F.array(*[F.lit(x) for x in ENCRYPTED_STREAMS]))
    return parts.where(marked).select("artifact_id", F.lit("E11").alias("rule_id"), F.lit("info").alias("severity"), F.col("part_path").alias("description"))


def encrypted_ole(items: DataFrame) -> DataFrame:
    """E11 on OLE files: a directory entry, whose name stands as UTF-16 before zero bytes, that names encryption."""
    names = F.array(*[F.when(F.contains("t", F.lit("".join(c + "\0" for c in name) + "\0\0")), F.lit(name)) for name in ENCRYPTED_STREAMS])
    found = items.select("artifact_id", F.explode(F.array_compact(names)).alias("description"))
    return found.withColumn("rule_id", F.lit("E11")).withColumn("severity", F.lit("info"))


def embedded_ole_findings(embedded: DataFrame) -> DataFrame:
    """E5: OLE files inside parts (artifact_id, offset)."""
    place = F.concat(F.lit("at byte "), F.col("offset").cast("string"))
    return embedded.select("artifact_id", "offset", _finding("E5", "info", "embedded OLE file", place).alias("f")).select("artifact_id", "offset", "f.*")


def hex_ole_findings(blobs: DataFrame) -> DataFrame:
    """OLE files in the hex of RTF."""
    return blobs.select("artifact_id", _finding("E6", "medium", "OLE file in hex", F.left("hex", F.lit(100))).alias("f")).select("artifact_id", "f.*")


def base64_findings(strings: DataFrame) -> DataFrame:
    """An artifact's possible base64, its first 20 runs."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", "value"))), 1, 20)
    listed = strings.where(F.col("pos") < 20).groupBy("artifact_id").agg(F.array_join(F.transform(first, lambda x: x["value"]), ", ").alias("d"))
    return listed.select("artifact_id", _finding("E12", "low", "possible base64", F.col("d")).alias("f")).select("artifact_id", "f.*")


PE_IN_HEX = r"4d5a[a-z0-9]{100,500}546869732070726f6772616d"


def blob_findings(blobs: DataFrame) -> DataFrame:
    """E4, E7, E8, E9 on carved hex blobs (hex, content) and their lens text t."""
    t = F.coalesce("t", F.lit(""))
    return exploded(
        blobs,
        ["artifact_id"],
        [
            (t.rlike("(?i)equation"), _finding("E4", "high", "equation in blob", F.regexp_extract(t, "((?i)equation)", 1))),
            (F.length("hex") > 0, _finding("E7", "medium", "hex blob", F.left("hex", F.lit(100)))),
            (F.contains(t, F.lit("Function")) | F.contains(t, F.lit("Sub ")), _finding("E8", "medium", "script function in blob", F.left(t, F.lit(100)))),
            (F.col("hex").rlike(PE_IN_HEX), _finding("E9", "high", "executable in hex", F.left("hex", F.lit(100)))),
        ],
    )


def dde_fields(df: DataFrame) -> DataFrame:
    """DDE commands in Word fields."""
    found = F.regexp_extract_all("t", F.lit(r"\x13\s*DDEAUTO[^\x14]+"), F.lit(0))
    return df.select("artifact_id", F.posexplode(found).alias("pos", "description")).withColumn("rule_id", F.lit("D16")).withColumn("severity", F.lit("high"))
