"""Text functions that SQL cannot express, in Arrow batches: those of whole documents as Arrow functions, which have one text in
hand at a time where pandas would hold a batch's texts as strings too, the others as pandas functions."""

from __future__ import annotations

import itertools
import json
import random
import re
import shlex
import zlib
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: programs by what they do to files
READERS = {"cat", "bat", "head", "tail", "less", "more", "nl", "od", "xxd", "ls", "stat", "file", "wc", "rg", "grep", "ag", "ack", "fgrep", "egrep", "find", "fd", "locate", "diff"}
PATTERN_FIRST = {"rg", "grep", "fgrep", "egrep", "ag", "ack"}
WRITERS = {"touch", "mkdir", "cp", "mv", "ln", "rm"}
PATCHERS = {"apply_patch", "patch"}
BUILDERS = {
    "pytest", "py.test", "unittest", "cargo", "rustc", "go", "gotest", "npm", "yarn", "pnpm", "bun", "make", "cmake", "ninja", "tox", "nox",
    "mvn", "gradle", "sbt", "ctest", "bazel", "buck", "tsc", "swc",
}
LINTERS = {"ruff", "mypy", "ty", "pyright", "black", "flake8", "eslint", "prettier", "isort", "autopep8", "uv", "pip", "poetry"}
WRAPPERS = {"sudo", "doas", "env", "nohup", "ionice", "nice", "time", "timeout", "stdbuf", "command", "exec", "builtin", "xargs"}
SHELLS = {"bash", "sh", "zsh"}
REDIRECTIONS = {">", ">>", "1>", "1>>", "2>", "2>>", "&>", "&>>"}
SEQUENCES = {"&&", "||", ";", "&"}
RANK = {"run": 0, "read": 1, "build": 2, "write": 3, "edit": 4}
# fixed values: at which aggressiveness a step begins
STEPS = {
    "aggressive": {"paths": 0.15, "linenum": 0.3, "indent": 0.5, "chardrop": 0.25, "minify": 0.3},
    "standard": {"paths": 0.3, "linenum": 0.5, "indent": 0.7, "chardrop": 0.4, "minify": 0.5},
    "gentle": {"paths": 0.5, "linenum": 0.7, "indent": 0.9, "chardrop": 0.7, "minify": 0.8},
}
_STRINGS = T.ArrayType(T.StringType())
INTENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("paths", _STRINGS), T.StructField("read_through", _STRINGS), T.StructField("program", T.StringType())])


def collapse_runs(text: str, least: int = 10) -> str:
    """Runs of one character become it, an asterisk and their length."""
    return re.sub(r"(.)\1{%d,}" % (least - 1), lambda m: f"{m[1]}*{len(m[0])}", text)


def redundancy(text: str) -> float:
    data = text.encode()
    return 1.0 - len(zlib.compress(data)) / len(data) if data else 0.0


def _strings(made: Iterable[str | None]) -> pa.Array:
    """An array of the texts made, few of which are Python's at once (pyarrow makes a list of what it iterates over)."""
    return pa.concat_arrays([pa.nulls(0, pa.string()), *(pa.array(part, pa.string()) for part in itertools.batched(made, 32))])


@F.arrow_udf(T.DoubleType())
def entropy_ratio(texts: pa.Array) -> pa.Array:
    return pa.array([redundancy(t.as_py() or "") for t in texts], pa.float64())


@F.arrow_udf(T.StringType())
def rle(texts: pa.Array) -> pa.Array:
    return _strings(collapse_runs(t.as_py()) if t.is_valid else None for t in texts)


# fixed values: words by which a text counts as code
CODE_WORDS = (
    r"(?:fn |def |class |import |use |pub |let |const |var |func |return |if |for |while |match |switch |struct |enum |trait "
    r"|async |await |module |package |from |require\(|#include)"
)
# fixed values: what a line of a package manager's progress begins with, and what a banner's lines hold
PROGRESS = ("Compiling ", "Downloading ", "Downloaded ", "Fresh ", "Updating ")
BANNER, BANNER_INSIDE, BANNER_AFTER_BLANK = ("____", "/ /", "/_/", "\\__"), ("____", "/ /", "/_/", "\\__", "/ \\"), ("____", "/ /", "/_/")


def minify_code(text: str) -> str:
    """Code without comment lines, comments over several lines, blank lines and lines that open a docstring; a blank for each
    four of indentation. Other text stays as it is."""
    if not re.search(CODE_WORDS, text):
        return text
    out, inside = [], False
    for line in map(str.rstrip, text.split("\n")):
        if inside:
            _, closed, rest = line.partition("*/")
            inside = not closed
            if rest.strip():
                out.append(rest.strip())
        elif "/*" in line and "*/" not in line:
            inside = True
            if before := line.partition("/*")[0].rstrip():
                out.append(before)
        elif (code := line.lstrip()) and not code.startswith(("//", "# ", "#!", '"""', "'''")):
            depth = (len(line) - len(code)) // 4
            head, remark, _ = code.partition(" //")
            if remark and not head.count('"') % 2 and not head.count("'") % 2:
                code = head.rstrip()
            out.append(" " * depth + code)
    return "\n".join(out)


def drop_characters(text: str, aggr: float, above: float = 0.4, least: int = 5, seed: int = 42) -> str:
    """Words of `least` letters and more lose inner letters, vowels first, more of them the longer the word; reruns agree.
    The choice is the standard library's sample from the same seed for each text."""
    if aggr < above or not text:
        return text
    rng = random.Random(seed)

    def thinned(m: re.Match) -> str:
        word = m[0]
        inner = word[1:-1]
        left = int(len(inner) * (aggr * 0.3 * min(len(word) / 12.0, 1.0)))
        if len(word) < least or left <= 0 or not any(map(str.isalpha, word)):
            return word
        gone: set[int] = set()
        for fits in (lambda c: c in "aeiouAEIOU", lambda c: c not in "aeiouAEIOU" and c.isalpha()):
            places = [i for i, c in enumerate(inner) if fits(c)]
            if places and left > len(gone):
                gone.update(rng.sample(places, min(left - len(gone), len(places))))
        return word[0] + "".join(c for i, c in enumerate(inner) if i not in gone) + word[-1]

    return re.sub(r"\w+", thinned, text)


def strip_banners(text: str) -> str:
    """Without banners drawn in slashes, bars and underscores, and the blank lines after them."""
    lines, out, k = text.split("\n"), [], 0
    drawn = lambda line: len(re.findall(r"[/_\\|]", line))
    holds = lambda line, marks: any(m in line for m in marks)
    while k < len(lines):
        if drawn(lines[k]) <= 8 or not holds(lines[k], BANNER):
            out.append(lines[k])
            k += 1
            continue
        while k < len(lines) and (holds(lines[k], BANNER_INSIDE) and drawn(lines[k]) > 5 or not lines[k].strip() and k + 1 < len(lines) and holds(lines[k + 1], BANNER_AFTER_BLANK)):
            k += 1
        while k < len(lines) and not lines[k].strip():
            k += 1
    return "\n".join(out)


def collapse_progress(text: str) -> str:
    """The first line of each run of a package manager's progress, and how many followed."""
    out = []
    for noise, run in itertools.groupby(text.split("\n"), lambda line: line.strip().startswith(PROGRESS)):
        lines = list(run)
        out += [lines[0], *([f"  [...{len(lines) - 1} more cargo lines...]"] if len(lines) > 1 else [])] if noise else lines
    return "\n".join(out)


def clean_shell_output(text: str) -> str:
    return collapse_progress(strip_banners(text))


def minify_json(text: str, below: float = 0.85) -> str | None:
    """JSON text without blanks, if that is below 85 % of it; null if not, or if it is no JSON."""
    try:
        short = json.dumps(json.loads(text), separators=(",", ":"))
    except ValueError:
        return None
    return short if len(short) < len(text) * below else None


def compress(text: str, aggr: float, profile: str, home: str) -> str:
    """The structural steps in their order; blank lines and runs always."""
    step = STEPS[profile]
    if aggr > step["paths"]:
        text = re.sub(re.escape(home) + r"/src/mine/([^/\s]+)/", r"~/\1/", text)
    if aggr > step["linenum"]:
        text = re.sub(r"^ *\d+[→│]\s?", "", text, flags=re.M)
    if aggr > step["indent"]:
        text = re.sub(r"^ {4,}", lambda m: " " * (len(m[0]) // 4 * 2 + len(m[0]) % 4), text, flags=re.M)
    if aggr > step["minify"]:
        text = minify_code(text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    if aggr > 0.3:
        text = text.encode("ascii", "ignore").decode()
    return drop_characters(collapse_runs(text), aggr, step["chardrop"])


def structural(profile: str, home: str):
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, aggr: pa.Array) -> pa.Array:
        return _strings(compress(t.as_py(), a.as_py(), profile, home) if t.is_valid else None for t, a in zip(texts, aggr, strict=True))

    return run


def dedup_reminders(text: str, tag: str = "system-reminder") -> str:
    """Without tagged passages that repeat an earlier one; a text that has any is stripped, and its blank lines collapsed."""
    seen: set[str] = set()

    def once(m: re.Match) -> str:
        new = m[0] not in seen
        seen.add(m[0])
        return m[0] if new else ""

    out = re.sub(rf"<{tag}>.*?</{tag}>", once, text, flags=re.S)
    return re.sub(r"\n{3,}", "\n\n", out).strip() if seen else text


def collapse_diff(text: str, around: int = 3) -> str:
    """A diff with `around` lines about each change of a hunk, and marks for the gaps between them. What stands before the
    first hunk stays, as do hunk headers and hunks without changes; a text without hunks stays as it is."""
    out: list[str] = []
    hunk: list[str] | None = None

    def close() -> None:
        changed = [i for i, x in enumerate(hunk or ()) if x.startswith(("+", "-"))]
        near = sorted({j for i in changed for j in range(i - around, i + around + 1) if 0 <= j < len(hunk)}) if changed else range(len(hunk or ()))
        for last, j in zip([None, *near], near):
            out.extend(["..."] * (last is not None and j > last + 1) + [hunk[j]])

    for line in text.split("\n"):
        if line.startswith("@@"):
            close()
            out.append(line)
            hunk = []
        elif hunk is None:
            out.append(line)
        else:
            hunk.append(line)
    close()
    return "\n".join(out)


def _parts(words: list[str], marks: set[str]) -> list[list[str]]:
    """The runs of words between marks, without empty ones."""
    return [list(run) for mark, run in itertools.groupby(words, marks.__contains__) if not mark]


def _unwrapped(words: list[str]) -> list[str]:
    """The words from the program on that wrappers (sudo, timeout 5, bash -c ...) run."""
    while words:
        if words[0] in SHELLS and len(words) >= 3 and words[1] == "-c":
            try:
                words = shlex.split(words[2])
            except ValueError:
                break
        elif words[0] in WRAPPERS:
            wrapper, words = words[0], words[1:]
            if wrapper == "timeout":
                words = words[1:]
            skip = {"env": lambda w: "=" in w and not w.startswith("-"), "xargs": lambda w: w.startswith("-")}.get(wrapper)
            words = list(itertools.dropwhile(skip, words)) if skip else words
        else:
            break
    return words


Intent = tuple[str, list[str], list[str], str | None]


def _command(words: list[str]) -> Intent:
    """(kind, paths, paths read on the way, program) of one program's words."""
    words = _unwrapped(words)
    targets, plain = [], []
    rest = iter(enumerate(words))
    for k, word in rest:
        if word in REDIRECTIONS and k + 1 < len(words):
            targets.append(next(rest)[1])
        elif not word.startswith("<"):
            plain.append(word)
    if not plain:
        return ("write" if targets else "run"), targets, [], None
    program = plain[0]
    files = [w for w in plain[1:] if not w.startswith("-") and not w.isdigit()]  # a number is nearly always a flag's
    if targets:
        return "write", targets, files if program in READERS else [], program
    if program == "sed":
        return ("edit" if any(w.startswith("-i") for w in plain) else "read"), files[1:], [], program
    if program in PATCHERS or (program == "git" and plain[1:2] == ["apply"]):
        return "edit", [], [], program
    if program in BUILDERS | LINTERS or (program.startswith("python") and plain[2:3] and plain[2] in BUILDERS):
        return "build", [], [], program
    if program == "tee" or program in WRITERS:
        return "write", files, [], program
    if program in READERS:
        return "read", files[1:] if program in PATTERN_FIRST else files, [], program
    return "run", [], [], program


def _pipeline(words: list[str]) -> Intent:
    """A pipeline is what its last program is; what the others read is read on the way."""
    found = [_command(part) for part in _parts(words, {"|"})] or [("run", [], [], None)]
    if len(found) == 1:
        return found[0]
    kind, paths, _, program = found[-1]
    return kind, paths, [p for k, own, _, _ in found[:-1] if k == "read" for p in own], program


def shell_intent(command: str | None) -> Intent:
    """(kind, paths, paths read on the way, program) of a shell command; the strongest of its parts counts, the first of equals."""
    try:
        words = shlex.split(command or "")
    except ValueError:
        words = []
    found = [_pipeline(part) for part in _parts(words, SEQUENCES)]
    if len(found) < 2:
        return found[0] if found else ("run", [], [], None)
    kind, paths, read, program = best = max(found, key=lambda x: RANK[x[0]])
    if kind == "run":
        return "run", [], [], found[-1][3]
    more = [p for x in found if x is not best for p in (x[1] if x[0] == "read" else []) + x[2]]
    return kind, paths, list(dict.fromkeys(read + more)), program


@F.pandas_udf(INTENT)
def shell(commands: pd.Series) -> pd.DataFrame:
    rows = [shell_intent(c) for c in commands]
    return pd.DataFrame(rows, columns=["kind", "paths", "read_through", "program"])
