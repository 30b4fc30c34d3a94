"""Line-first cleaning of documents.

Every line is judged alone; failing lines go; a document goes when it fails the
base rules or loses more than ``max_lost`` of its word characters with its lines.
Lines are the ``\\n``-split parts of the text, words ``[^\\x20\\x09-\\x0D]+``.

A line fails for

* punctuation: five words or more, and over 15 of 100 of its word characters are ASCII
  punctuation, unless it is code or a formula: at most 65 of 100, and it has an operator
  for a word (``=``, ``:=``, ``->`` ...) or stands in a run of three such lines or more;
* no sentence: ten words or more and no sentence end of any script, neither itself nor in
  the lines that continue it or that it continues, unless it has an operator for a word or
  is verse: in a run of three lines or more, at least half of its words without a capital;
* navigation: at least four of its words are separators and they are at least 15 of 100
  words; or at least two are bars, bullets or angle quotes, with at most four other words
  for each part on average, and the line (with those it is read with) has no sentence end;
* boilerplate: up to 30 words, and phrases of notices and menus make up most of its words,
  or it has such a phrase and no sentence end (with those it is read with). A whole
  sentence that only mentions one stays. Phrases are whole words, with a plural s or not,
  without the punctuation around words.

A line is continued by the next one, with no line without words between, when the next
starts with a lower-case letter, or when both stand in a hard-wrapped paragraph: at
least three lines of at most 120 characters, each but the last too long to take the
next one's first word within the longest. Thai and Lao have no sentence ends; a letter
of theirs counts as one. Runs are counted between lines without words.

Cases: a null text has no words (all counts 0, base_failed, not kept) and stays
null when cleaned; an empty text likewise stays empty. Lines without words never
fail. Repeated rows are judged each. Other columns are carried along untouched.
"""

import re
from itertools import groupby
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import (CONTINUATION, LOWER, SPACES, code_points, col, ids_of, per_text, table,
                                   windows)

PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b";", b":", "。".encode(), "…".encode())
# Sentence_Terminal of Unicode beyond ASCII, semicolons, colons and ellipses
# of other scripts, and the letters of Thai and Lao.
ALL_ENDS = (
    r".!?;:\u2026\u22ef\u037e\u055c\u055e\u0589\u061b\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e"
    r"\u0964\u0965\u0f0d-\u0f11\u104a\u104b\u1362-\u1368\u166e\u1735\u1736\u17d4-\u17d6\u1803\u1809\u1944\u1945"
    r"\u1aa8-\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d\u1b7e\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047-\u2049\u2e2e"
    r"\u2e3c\u2e53\u2e54\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d-\uaa5f"
    r"\uaaf0\uaaf1\uabeb\ufe12-\ufe16\ufe19\ufe52\ufe54-\ufe57\uff01\uff0e\uff1a\uff1b\uff1f\uff61\U00010a56\U00010a57"
    r"\U00010f55-\U00010f59\U00010f86-\U00010f89\U00011047\U00011048\U000110be-\U000110c1\U00011141-\U00011143"
    r"\U000111c5\U000111c6\U000111cd\U000111de\U000111df\U00011238\U00011239\U0001123b\U0001123c\U000112a9"
    r"\U0001144b\U0001144c\U000115c2\U000115c3\U000115c9-\U000115d7\U00011641\U00011642\U0001173c-\U0001173e"
    r"\U00011944\U00011946\U00011a42\U00011a43\U00011a9b\U00011a9c\U00011c41\U00011c42\U00011ef7\U00011ef8"
    r"\U00011f43\U00011f44\U00016a6e\U00016a6f\U00016af5\U00016b37\U00016b38\U00016b44\U00016e98\U0001bc9f\U0001da88"
    r"\u0e01-\u0e2f\u0e5a\u0e5b\u0e81-\u0eae")
# Words that only separate menu items.
SEPARATORS = frozenset(x.encode() for x in ("|", ">", "<", "/", "»", "«", "›", "•", "·", "::", "-", "–"))
BARS = frozenset(x.encode() for x in ("|", "»", "«", "›", "•", "·", "::"))
OPERATORS = frozenset(x.encode() for x in ("=", "==", "!=", ":=", "+=", "-=", "<=", ">=", "=>", "->"))
# Phrases of notices and menus, in lower case.
PHRASES = (
    "we use cookies", "cookies help us", "copyright",
    "all rights reserved", "accept cookies", "cookie policy", "cookie settings", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "subscribe to our", "newsletter",
    "click here", "read more", "sign in", "sign up", "log in", "skip to content", "back to top",
    "share this", "follow us", "enable javascript", "powered by", "lorem ipsum",
)
MIN_WORDS, LONG_LINE, PHRASE_WORDS = 5, 10, 30
PUNCTUATION_PCT, CODE_PCT, SEPARATOR_PCT, MIN_SEPARATORS = 15, 65, 15, 4
MIN_BARS, PART_WORDS, RUN_LINES = 2, 4, 3
WRAP_LINES, WRAP_CHARS = 3, 120
ROWS = 1000  # rows that a task of the cleaning stage holds at once
MAX_LOST_PCT = 50
MIN_DOC_WORDS, REPEAT_WIDTH, MAX_REPEAT_PCT = 10, 5, 20

COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_cut_lines long, cut_chars long")
# words stand between blanks of their own, so that phrases that follow each other all match
_spaced = "|".join(p.replace(" ", "  ") for p in PHRASES)
_phrase = re.compile(f" (?:{_spaced})s? ".encode())
_perhaps = re.compile("|".join(p.replace(" ", "[^0-9a-z_]+") for p in PHRASES).encode())
_edges = re.compile(rb"^[^0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff]+$")
_end = re.compile(f"[{ALL_ENDS}]")


def ends(line: bytes) -> bool:
    """Whether the line has a sentence end of any script."""
    return any(e in line for e in ENDS) or not line.isascii() and bool(_end.search(line.decode("utf-8", "replace")))


def continued(lines: list) -> list:
    """For the lines of a paragraph but the last, whether the next continues them."""
    chars = [code_points(line.strip()) for line in lines]
    first = [code_points(line.split(None, 1)[0]) for line in lines]
    longest = max(chars)
    if len(lines) >= WRAP_LINES and longest <= WRAP_CHARS and all(
            n + 1 + w > longest for n, w in zip(chars, first[1:])):
        return [True] * (len(lines) - 1)
    return [category(line.lstrip()[:4].decode("utf-8", "ignore")[:1]) == "Ll" for line in lines[1:]]


def without_end(lines: list) -> list:
    """For each line whether it and the lines that it is read with have no sentence end."""
    out, paragraph = [], []

    def close():
        joined = [*continued(paragraph), False] if len(paragraph) > 1 else [False] * len(paragraph)
        begin = 0
        for k, more in enumerate(joined):
            if not more:
                out.extend([not any(map(ends, paragraph[begin:k + 1]))] * (k + 1 - begin))
                begin = k + 1
        paragraph.clear()

    for line in lines:
        if line.strip():
            paragraph.append(line)
        else:
            close()
            out.append(False)
    close()
    return out


def phrase_words(words: list) -> int:
    """Words of the line that belong to phrases of notices and menus."""
    bare = b"".join(b" %b " % _edges.sub(b"", w.translate(LOWER)) for w in words)
    return sum(len(m.split()) for m in _phrase.findall(bare))


def much_punctuation(line: bytes, words: list) -> int:
    """0, 1 for more than ``PUNCTUATION_PCT``, 2 for more than ``CODE_PCT``."""
    marks = len(line) - len(line.translate(None, PUNCTUATION))
    if len(words) < MIN_WORDS or not marks:
        return 0
    chars = len(line.translate(None, SPACES + CONTINUATION))
    return (100 * marks > PUNCTUATION_PCT * chars) + (100 * marks > CODE_PCT * chars)


def capital(word: bytes) -> bool:
    """Whether the word begins with a capital letter of any script."""
    return 65 <= word[0] <= 90 or word[0] > 127 and category(word[:4].decode("utf-8", "ignore")[:1]) in ("Lu", "Lt")


def runs(flags: list) -> list:
    """For each line the number of lines with its flag in a row that it stands in; 0 without."""
    out = [0] * len(flags)
    for flag, group in groupby(range(len(flags)), flags.__getitem__):
        if flag:
            group = list(group)
            out[group[0]:group[-1] + 1] = [len(group)] * len(group)
    return out


def failing(lines: list) -> list:
    """Whether each line fails; None for lines without words."""
    words = [line.split() for line in lines]
    no_end = [bool(w) and not any(e in line for e in ENDS) for line, w in zip(lines, words)]
    if any(no_end):
        no_end = without_end(lines)
    marks = [much_punctuation(line, w) for line, w in zip(lines, words)]
    code_run = runs([m == 1 for m in marks]) if 1 in marks else marks
    run = runs([bool(w) for w in words]) if any(no_end) else marks
    perhaps = bool(_perhaps.search(b"\n".join(lines).translate(LOWER)))
    out = []
    for k, own in enumerate(words):
        n = len(own)
        if not n:
            out.append(None)
            continue
        seps = sum(w in SEPARATORS for w in own)
        bars = sum(w in BARS for w in own) if seps else 0
        formula = (marks[k] or no_end[k]) and any(w in OPERATORS for w in own)
        phrases = phrase_words(own) if perhaps and n <= PHRASE_WORDS else 0
        out.append(
            marks[k] == 2 or marks[k] == 1 and code_run[k] < RUN_LINES and not formula
            or seps >= MIN_SEPARATORS and 100 * seps >= SEPARATOR_PCT * n
            or no_end[k] and bars >= MIN_BARS and n - bars <= PART_WORDS * (bars + 1)
            or 2 * phrases > n or phrases > 0 and no_end[k]
            or n >= LONG_LINE and no_end[k] and not formula and not (
                run[k] >= RUN_LINES and 2 * sum(map(capital, own)) <= n))
    return out


def repeated_words(words: list, width: int = REPEAT_WIDTH) -> int:
    """Words inside runs of ``width`` words that occur at least twice."""
    if len(words) < width + 1:
        return 0
    code = windows(ids_of(words), width)
    often = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge(text: bytes) -> tuple:
    """The counts of a text as in ``COUNTS``, and the text without failing lines."""
    if not text:
        return (0,) * 8, text
    words, lines = text.split(), text.split(b"\n")
    full, kept, n_cut, cut_chars = [], [], 0, 0
    for line, fails in zip(lines, failing(lines)):
        if fails is not None:
            full.append(line)
            if fails:
                n_cut += 1
                cut_chars += len(line.translate(None, SPACES + CONTINUATION))
                continue
        kept.append(line)
    counts = (len(words), len(text.translate(None, SPACES + CONTINUATION)),
              len(text) - len(text.translate(None, SYMBOLS)), len(full) - len(set(full)),
              repeated_words(words), len(full), n_cut, cut_chars)
    return counts, b"\n".join(kept) if n_cut else text


def _counts(only_cut: bool = False):
    """With ``only_cut`` a text that loses no line has a null in place of its cleaned text."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def apply(texts):
        rows = [judge(t) for t in texts]
        if only_cut:
            rows = [(counts, clean if counts[6] else None) for counts, clean in rows]
        made = {n: pa.array([r[0][k] for r in rows], pa.int64()) for k, n in enumerate(names)}
        made["clean"] = pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())
        made["clean_chars"] = pa.array([None if r[1] is None else code_points(r[1]) for r in rows],
                                       pa.int64())
        return made
    return apply


def _verdicts(df: DataFrame) -> DataFrame:
    failed = ((F.col("n_words") < MIN_DOC_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return (df.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed")
                        & (100 * F.col("cut_chars") <= MAX_LOST_PCT * F.col("word_chars"))))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, counts, base_failed, kept, and the cleaned text."""
    judged = per_text(docs, text, _counts, f"{COUNTS}, clean string, clean_chars long",
                      {key: col(key)})
    return _verdicts(judged)


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines; same columns.

    ``n_chars``, where there is such a column, is set anew for texts that lost lines.
    """
    judged = _verdicts(per_text(docs, text, lambda: _counts(True), f"{COUNTS}, clean string, clean_chars long",
                                {f"given_{i}": col(c) for i, c in enumerate(docs.columns)}, ROWS))
    kept, cut = judged.where("kept"), F.col("n_cut_lines") > 0
    out = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"given_{i}")
        if c == text:
            value = F.when(cut, F.col("clean")).otherwise(value)
        elif c == n_chars:
            value = F.when(cut, F.col("clean_chars").cast(docs.schema[i].dataType)).otherwise(value)
        out.append(value.alias(c))
    return kept.select(*out)


def _sql() -> str:
    marks = r"[!-/:-@\[-`{-~]"
    listed = lambda values: ", ".join(f"'{v.decode()}'" for v in sorted(values))
    ends = re.sub(r"\\(?:u|U000)([0-9a-f]+)", r"\\x{\1}", ALL_ENDS)
    edge = r"[^0-9a-z_\x{80}-\x{10ffff}]+"
    upper, lower = (bytes(range(x, x + 26)).decode() for x in (65, 97))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
           FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM w)),
split AS (
  SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         length(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS width,
         len(regexp_extract_all(line, '{marks}')) AS marks FROM lines),
judged AS (
  SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: x IN ({listed(SEPARATORS)}))) AS seps,
         len(list_filter(ws, lambda x: x IN ({listed(BARS)}))) AS bars,
         len(list_filter(ws, lambda x: x IN ({listed(OPERATORS)}))) AS operators,
         len(list_filter(ws, lambda x: regexp_matches(x, '^[\p{{Lu}}\p{{Lt}}]'))) AS capitals,
         regexp_matches(line, '[{ends}]') AS ends,
         CASE WHEN len(ws) < {MIN_WORDS} OR marks = 0 THEN 0
              WHEN 100 * marks > {CODE_PCT} * chars THEN 2
              WHEN 100 * marks > {PUNCTUATION_PCT} * chars THEN 1 ELSE 0 END AS much,
         list_sum(list_transform(regexp_extract_all(array_to_string(list_transform(ws, lambda x:
           ' ' || regexp_replace(translate(x, '{upper}', '{lower}'), '^{edge}|{edge}$', '', 'g') || ' '), ''),
           ' (?:{_spaced})s? '), lambda m: len(regexp_extract_all(m, '[^ ]+')))) AS found
  FROM split),
-- paragraphs are the lines between lines without words, code runs those of like lines
parts AS (
  SELECT *, count(*) FILTER (WHERE n = 0) OVER so_far AS para, count(*) FILTER (WHERE much <> 1) OVER so_far AS code
  FROM judged WINDOW so_far AS (PARTITION BY doc_id ORDER BY no)),
full_lines AS (
  SELECT *, count(*) OVER p AS run, count(*) FILTER (WHERE much = 1) OVER (PARTITION BY doc_id, code) AS code_run,
         max(width) OVER p AS longest, lag(width) OVER o AS width_before
  FROM (SELECT * FROM parts WHERE n > 0)
  WINDOW p AS (PARTITION BY doc_id, para), o AS (PARTITION BY doc_id, para ORDER BY no)),
wrapped AS (
  SELECT *, run >= {WRAP_LINES} AND longest <= {WRAP_CHARS}
            AND coalesce(bool_and(width_before + 1 + length(ws[1]) > longest) OVER (PARTITION BY doc_id, para), true)
            AS wraps FROM full_lines),
units AS (
  SELECT *, count(*) FILTER (WHERE NOT (width_before IS NOT NULL
              AND (wraps OR regexp_matches(line, '^[\x20\x09-\x0D]*\p{{Ll}}'))))
            OVER (PARTITION BY doc_id, para ORDER BY no) AS unit FROM wrapped),
known AS (SELECT *, NOT bool_or(ends) OVER (PARTITION BY doc_id, para, unit) AS no_end,
                 CASE WHEN n <= {PHRASE_WORDS} THEN coalesce(found, 0) ELSE 0 END AS phrases FROM units),
failing AS (
  SELECT *, much = 2 OR much = 1 AND code_run < {RUN_LINES} AND operators = 0
    OR seps >= {MIN_SEPARATORS} AND 100 * seps >= {SEPARATOR_PCT} * n
    OR no_end AND bars >= {MIN_BARS} AND n - bars <= {PART_WORDS} * (bars + 1)
    OR 2 * phrases > n OR phrases > 0 AND no_end
    OR n >= {LONG_LINE} AND no_end AND operators = 0 AND NOT (run >= {RUN_LINES} AND 2 * capitals <= n) AS fails
  FROM known),
line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (WHERE fails) AS n_cut_lines,
         coalesce(sum(chars) FILTER (WHERE fails), 0) AS cut_chars
  FROM failing GROUP BY doc_id),
word_runs AS (
  SELECT doc_id, i, words[i : i + {REPEAT_WIDTH - 1}] AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {REPEAT_WIDTH - 2})) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM word_runs)
          WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words
             FROM (SELECT DISTINCT doc_id, i + k AS at FROM often, range(0, {REPEAT_WIDTH}) AS r(k))
             GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_cut_lines, 0) AS BIGINT) AS n_cut_lines,
         CAST(coalesce(cut_chars, 0) AS BIGINT) AS cut_chars
  FROM w LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < {MIN_DOC_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_DOC_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
       AND 100 * cut_chars <= {MAX_LOST_PCT} * word_chars AS kept
FROM counts"""


@query("op1_quality_rules", _sql())
def op1(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean", "clean_chars")
