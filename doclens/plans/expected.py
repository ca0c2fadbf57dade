"""Patterns and words as the checking SQL has them: written out here, so that a wrong one in the library shows."""

from __future__ import annotations

from doclens.operators.rules import Rule

ASCII_RUN = r"[\x20-\x7e]{10,1000}"
WIDE_RUN = r"(?:[\x20-\x7e]\x00){5,}"
PRINTABLE_RUN = r"[\x20-\x7e\t\n\r\x0b\x0c]{7,}"
BASE64_RUN = r"(?:[A-Za-z0-9+/]{4}){13,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
PDF_OBJECT = r"[0-9]+ [0-9]+ obj[\x00-\xff]*?endobj"
RTF_OLE = r"(d0cf11e[\x00-\x66]+)\}"
RTF_AUX = r"[A-Za-z]\}?((?:[0-9a-fA-F]{2}){50,})(?:\{|\\|\})"
FUNCTION_NAME = r"Function [A-Za-z0-9_]{3,20}"
URI = r"URI ?\([^)]*\)"
EXPORT = r"this\.exportDataObject\([^)]*\)"
UNC = r"F ?\(\\\\[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\\[^)]*\)"
FILE_REF = r"/F ?\([^)]*\)"
REFS = [("js", r"JS ([0-9]+) 0 R"), ("open_action", r"/OpenAction ([0-9]+) 0 R"), ("o", r"/O ([0-9]+) 0 R"), ("f", r"/F ([0-9]+) 0 R")]
PE_IN_HEX = r"4d5a[a-z0-9]{100,500}546869732070726f6772616d"
FRAME = r'frame" Target="[^"]*" TargetMode="External"/></Relationships>'
RELS = [
    ("O1", r'oleObject" Target="mhtml:[^"]*"[^>]*TargetMode="External"'),
    ("O2", r'attachedTemplate" Target="http[^"]*"[^>]*TargetMode="External"'),
    ("O3", r'hyperlink" Target="[^"]*" TargetMode="External"'),
    ("O4", r'oleObject" TargetMode="External" Target="[^"]*"'),
]
SEVERITIES = ["info", "low", "medium", "high"]

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
