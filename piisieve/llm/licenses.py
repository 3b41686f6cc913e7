"""License scans as ordered signature rules: keyword-gated regexes, then priority and interval-containment suppression.

The whole scan is one projection of column expressions (no shuffle, no Python):

1. A text is lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`: digits, a-z and anything
   outside ASCII.
2. The words are written as " 0:w0 1:w1 ... " so that a regex match carries the number of its first word; a ':' never
   stands in a word, so `\\d+:` marks a word's start without doubt.
3. Keyword prefilter: of the rules, only those whose keyword is among the text's distinct words are tried.
4. Each tried rule's regex (written over words separated by one space, and turned into the numbered form by
   `numbered_pattern`) gives detections (first word, number of words, priority, label, weight).
5. Suppression: detections sorted by (start, end descending, priority, rule) are passed once; a detection is dropped if
   an earlier one of the same or a higher priority (smaller number) covers its interval. Nested names ("GNU Lesser
   General Public License" over "General Public License") and equal spans of two rules resolve to the higher priority.
6. score = 1 - prod(1 - weight) over the detections that stay; 0 without any.

Cost is linear in the text (the sort and the pass are linear in detections); a row is never copied per hit.

Defined results: a null or empty text has no words: n_words 0, n_base 0, null first_word and last_word, empty
labels, score 0. Null ids stay null; repeated rows and ties give repeated, equal results (each row is judged on its
own). Very long texts are scanned whole. Extra input columns are not carried, so their names cannot clash. An empty
table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.functions.arrays import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What is not part of a word: ASCII but for digits and a-z (A-Z are lower-cased before).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases of the contract and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Rule priorities: a detection is only suppressed by one of the same or a smaller number.
EXACT, FAMILY, NOTICE = 1, 2, 3
WEIGHTS = {EXACT: 0.9, FAMILY: 0.7, NOTICE: 0.4}

LICENSE = "licen[cs]e"
# Families with versions: (label stem, keyword, names, versions as words). Each (name, version) is a rule.
VERSIONED = [
    ("apache", "apache", ["apache LICENSE", "apache software LICENSE"], ["1 0", "1 1", "2 0"]),
    ("gpl", "gnu", ["gnu general public LICENSE", "gnu gpl"], ["1 0", "2 0", "3 0"]),
    ("lgpl", "gnu", ["gnu lesser general public LICENSE", "gnu library general public LICENSE", "gnu lgpl"], ["2 0", "2 1", "3 0"]),
    ("agpl", "affero", ["gnu affero general public LICENSE", "affero general public LICENSE", "affero gpl"], ["1 0", "3 0"]),
    ("gfdl", "documentation", ["gnu free documentation LICENSE"], ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", ["mozilla public LICENSE"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public LICENSE"], ["1 0", "2 0"]),
    ("cddl", "distribution", ["common development and distribution LICENSE"], ["1 0", "1 1"]),
    ("bsl", "boost", ["boost software LICENSE"], ["1 0"]),
    ("afl", "academic", ["academic free LICENSE"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("osl", "open", ["open software LICENSE"], ["1 0", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic", ["artistic LICENSE"], ["1 0", "2 0"]),
    ("eupl", "european", ["european union public LICENSE"], ["1 0", "1 1", "1 2"]),
    ("ofl", "font", ["sil open font LICENSE", "open font LICENSE"], ["1 0", "1 1"]),
    ("lppl", "latex", ["latex project public LICENSE"], ["1 0", "1 1", "1 2", "1 3a", "1 3c"]),
    ("zpl", "zope", ["zope public LICENSE"], ["1 1", "2 0", "2 1"]),
    ("php", "php", ["php LICENSE"], ["3 0", "3 01"]),
    ("python", "python", ["python software foundation LICENSE"], ["2 0"]),
    ("cecill", "cecill", ["cecill free software LICENSE agreement", "cecill"], ["1 0", "2 0", "2 1"]),
]
# Creative Commons: (short words, long words) of each kind, and versions.
CC_KINDS = [
    ("by", "attribution"),
    ("by sa", "attribution (?:sharealike|share alike)"),
    ("by nd", "attribution (?:noderivatives|noderivs|no derivatives)"),
    ("by nc", "attribution (?:noncommercial|non commercial)"),
    ("by nc sa", "attribution (?:noncommercial|non commercial) (?:sharealike|share alike)"),
    ("by nc nd", "attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives)"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Rules without a version: (label, keyword, regex over words, priority).
PLAIN = [
    ("gpl", "gnu", f"gnu general public {LICENSE}", FAMILY),
    ("gpl", "gpl", "gpl", FAMILY),
    ("lgpl", "gnu", f"gnu (?:lesser|library) general public {LICENSE}", FAMILY),
    ("lgpl", "lgpl", "lgpl", FAMILY),
    ("agpl", "affero", f"(?:gnu )?affero general public {LICENSE}", FAMILY),
    ("apache", "apache", f"apache {LICENSE}", FAMILY),
    ("mit", "mit", f"(?:the )?mit {LICENSE}", EXACT),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", EXACT),
    ("bsd", "bsd", f"bsd {LICENSE}", FAMILY),
    ("bsd", "bsd", "bsd", FAMILY),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", FAMILY),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd)", EXACT),
    ("bsd-2-clause", "freebsd", "freebsd", EXACT),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|revised bsd|modified bsd)", EXACT),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", EXACT),
    ("isc", "isc", f"isc {LICENSE}", EXACT),
    ("zlib", "zlib", f"zlib {LICENSE}", EXACT),
    ("x11", "x11", f"x11 {LICENSE}", EXACT),
    ("unlicense", "unlicense", "(?:the )?unlicense", EXACT),
    ("wtfpl", "wtfpl", "wtfpl", EXACT),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?", EXACT),
    ("cc0-1.0", "commons", "creative commons zero(?: 1 0)?", EXACT),
    ("cc", "commons", f"creative commons(?: {LICENSE})?", FAMILY),
    ("mpl", "mozilla", f"mozilla public {LICENSE}", FAMILY),
    ("epl", "eclipse", f"eclipse public {LICENSE}", FAMILY),
    ("public-domain", "domain", "(?:released |dedicated )?(?:in|into|to) the public domain", NOTICE),
    ("public-domain", "domain", "public domain", NOTICE),
    ("reserved", "reserved", "all rights reserved", NOTICE),
    ("copyright", "copyright", "copyright(?: c| ©)?(?: (?:19|20)[0-9][0-9])+", NOTICE),
    ("copyright", "©", "©(?: (?:19|20)[0-9][0-9])+", NOTICE),
    ("proprietary", "proprietary", "proprietary and confidential", NOTICE),
    ("proprietary", "copying", "unauthori[sz]ed copying of this file", NOTICE),
    ("proprietary", "permission", "may not be (?:copied|reproduced|distributed) without (?:the )?(?:express )?(?:written )?permission", NOTICE),
]


# SPDX identifiers, as words, of the licenses without a version above.
SPDX_PLAIN = [
    ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("cc0-1.0", "cc0 1 0"),
]


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


def _version_words(version: str) -> str:
    """"3 0" also stands as "3" or "v3"; "2 1" as "v2 1"; "version" may stand before."""
    major, _, minor = version.partition(" ")
    tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
    return f"(?:version |v)?{major}{tail}"


def rules() -> list[tuple[int, str, str, str, int]]:
    """All rules as (rule_id, label, keyword, regex over words, priority), in order of priority and then of writing."""
    out: list[tuple[str, str, str, int]] = []
    for stem, keyword, names, versions in VERSIONED:
        for version in versions:
            label = f"{stem}-{_dotted(version)}"
            for name in names:
                out.append((label, keyword, f"{name.replace('LICENSE', LICENSE)} {_version_words(version)}", EXACT))
            out.append((label, "spdx", f"spdx {LICENSE} identifier {stem} {version}(?: only| or later)?", EXACT))
    for short, long in CC_KINDS:
        for version in CC_VERSIONS:
            label = f"cc-{short.replace(' ', '-')}-{_dotted(version)}"
            out.append((label, "cc", f"cc {short} {version}", EXACT))
            out.append((label, "commons", f"creative commons {long} {version}(?: international| unported| generic)?", EXACT))
            out.append((label, "spdx", f"spdx {LICENSE} identifier cc {short} {version}", EXACT))
    out.extend(PLAIN)
    out.extend((label, "spdx", f"spdx {LICENSE} identifier {words}", EXACT) for label, words in SPDX_PLAIN)
    ordered = sorted(out, key=lambda rule: rule[3])
    return [(i, *rule) for i, rule in enumerate(ordered)]


def numbered_pattern(words_regex: str) -> str:
    """A regex over words separated by one space, made to match the numbered words " 0:w0 1:w1 ... ".

    Every space of the regex separates two words; the match starts and ends at whole words.
    """
    return r"(?<= )\d+:" + words_regex.replace(" ", r" \d+:") + "(?= )"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, NOT_WORD, -1), lambda word: word != "")


def numbered_words(words: Column) -> Column:
    """" 0:w0 1:w1 ... ", with a space at both ends."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " "), F.lit(" "))


def _starts(numbered: Column, words_regex: str) -> Column:
    """Word numbers at which the regex matches, in order."""
    pattern = r"(?<= )(\d+):" + words_regex.replace(" ", r" \d+:") + "(?= )"
    return F.transform(F.regexp_extract_all(numbered, F.lit(pattern), 1), lambda s: s.cast("long"))


def _sql_text(value: str) -> str:
    assert "'" not in value
    return f"r'{value}'"


def _rule_table() -> Column:
    """The rules as one constant array of structs, which the optimizer folds into a single literal."""
    structs = ", ".join(
        f"named_struct('rule_id', {i}, 'label', {_sql_text(label)}, 'keyword', {_sql_text(keyword)}, "
        f"'pattern', {_sql_text(numbered_pattern(regex))}, 'priority', {priority}, 'weight', CAST({WEIGHTS[priority]} AS DOUBLE))"
        for i, label, keyword, regex, priority in rules()
    )
    return F.expr(f"array({structs})")


def _keywords() -> Column:
    return F.expr(f"array({', '.join(_sql_text(k) for k in sorted({rule[2] for rule in rules()}))})")


def _detections(numbered: Column, words: Column) -> Column:
    """Sorted structs (start, minus end, priority, rule_id, label, weight) of the rules whose keyword the text has.

    Values that lambdas use are bound once by `let`; a lambda would evaluate them again for each element.
    """
    present = F.array_intersect(F.array_distinct(words), _keywords())
    return let(present, lambda present: _found(numbered, F.filter(_rule_table(), lambda rule: F.array_contains(present, rule["keyword"]))))


def _found(numbered: Column, tried: Column) -> Column:
    found = F.flatten(
        F.transform(
            tried,
            lambda rule: F.transform(
                F.regexp_extract_all(numbered, rule["pattern"], 0),
                lambda match: let(
                    F.regexp_extract(match, r"^(\d+):", 1).cast("long"),
                    lambda start: F.struct(
                        start.alias("start"),
                        (-(start + F.size(F.split(match, " ")))).alias("minus_end"),
                        rule["priority"].alias("priority"),
                        rule["rule_id"].alias("rule_id"),
                        rule["label"].alias("label"),
                        rule["weight"].alias("weight"),
                    ),
                ),
            ),
        )
    )
    return F.array_sort(found)


def _suppressed_pass(detections: Column) -> Column:
    """One pass over sorted detections: struct(labels that stay, their number, sum of log(1 - weight))."""
    levels = (EXACT, FAMILY, NOTICE)
    start = F.struct(
        *(F.lit(-1).cast("long").alias(f"end{level}") for level in levels),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).cast("long").alias("kept"),
        F.lit(0.0).alias("log_miss"),
    )

    def step(acc: Column, det: Column) -> Column:
        end = -det["minus_end"]
        covered = F.coalesce(*(F.when(det["priority"] == level, acc[f"end{level}"] >= end) for level in levels))
        return F.struct(
            *(F.when(det["priority"] <= level, F.greatest(acc[f"end{level}"], end)).otherwise(acc[f"end{level}"]).alias(f"end{level}") for level in levels),
            F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(det["label"]))).alias("labels"),
            (acc["kept"] + F.when(covered, 0).otherwise(1)).alias("kept"),
            (acc["log_miss"] + F.when(covered, 0.0).otherwise(F.log(1.0 - det["weight"]))).alias("log_miss"),
        )

    return F.aggregate(detections, start, step)


def _joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections), one per row.

    n_base counts every place of a base phrase; first_word/last_word are the smallest and largest word number at which
    one starts (null without any). labels holds the base labels and those of the rules that stay after suppression.
    """

    def scan(words: Column) -> Column:
        return let(
            numbered_words(words),
            lambda numbered: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.array(*(F.struct(F.lit(label).alias("label"), _starts(numbered, phrase).alias("starts")) for phrase, label in BASE_PHRASES)).alias("base"),
                _suppressed_pass(_detections(numbered, words)).alias("kept"),
            ),
        )

    scanned = df.select(F.col(id_col), let(words_of(F.col(text_col)), scan).alias("_scan")).select(
        id_col, "_scan.n_words", F.col("_scan.base").alias("_base"), F.col("_scan.kept").alias("_kept")
    )
    base_starts = F.flatten(F.transform("_base", lambda b: b["starts"]))
    base_labels = F.transform(F.filter("_base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])
    return scanned.select(
        id_col,
        "n_words",
        F.size(base_starts).cast("long").alias("n_base"),
        F.array_min(base_starts).alias("first_word"),
        F.array_max(base_starts).alias("last_word"),
        _joined_labels(base_labels).alias("base_labels"),
        _joined_labels(F.concat(base_labels, F.col("_kept.labels"))).alias("labels"),
        (1.0 - F.exp(F.col("_kept.log_miss"))).alias("score"),
        F.col("_kept.kept").alias("n_detections"),
    )


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
