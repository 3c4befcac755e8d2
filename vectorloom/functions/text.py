"""Text functions: normalisation, hashes, shingles, prompts, filters and the parsing of names and logs. All are columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import let

#: Query instructions by teacher and data set kind; {task} is the data set's own sentence.
INSTRUCTION = "Instruct: {task}\nQuery: "


def normalise(s: Column) -> Column:
    """Null is empty; lower case; every run of Unicode white space is one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "))


def full_text(title: Column, text: Column) -> Column:
    """Title and text with a space between, trimmed; nulls are empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def content_hash(s: Column) -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(normalise(s), 256)


def tokens(s: Column) -> Column:
    """Words of the normalised text; none for an empty one."""
    return let(normalise(s), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")))


def token_count(s: Column) -> Column:
    return F.size(tokens(s))


def shingles(words: Column, size: int = 5) -> Column:
    """Hashes of the distinct word shingles of an array of words; fewer words are one shingle, no words have none.

    Words are hashed once, and shifted copies of the hashes are zipped.
    """

    def zipped(h: Column) -> Column:
        n = F.greatest(F.size(h) - (size - 1), F.lit(1))
        return F.transform(F.arrays_zip(*[F.slice(h, i + 1, n).alias(f"w{i}") for i in range(size)]), lambda z: F.xxhash64(z))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(zipped(h))))


def truncate(s: Column, chars: int) -> Column:
    return F.substring(F.coalesce(s, F.lit("")), 1, chars)


def truncate_tokens(s: Column, most: int) -> Column:
    """The first `most` white-space words."""
    return F.array_join(F.slice(tokens(s), 1, most), " ")


def passage(title: Column, text: Column, prefix: str = "") -> Column:
    """What is encoded for a document: prefix, title and a line break, text; without a title prefix and text."""
    t, x = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.lit(prefix), F.when(t != "", F.concat(t, F.lit("\n"), x)).otherwise(x))


def instruction(task: Column, fallback: Column) -> Column:
    """A query's prompt: the task's instruction where there is one, else the teacher's own prefix; an error where there is neither."""
    lead, tail = INSTRUCTION.split("{task}")
    return F.coalesce(F.concat(F.lit(lead), task, F.lit(tail)), fallback, F.raise_error(F.lit("no prompt for this data set")))


#: Fixed values of the paragraph filter: signs that a paragraph must not begin with, signs that it must end with, marks that it must not hold, and leads of disambiguation pages with the characters in which they are looked for.
BAD_START = ("*", "-", "#", ":", "|", "{", "!", "=", "•")
GOOD_END = (".", "!", "?", '"', "“", "”", "»", ")")
MARKS = ("|", "{{", "}}", "[[", "\t")
LEADS = (("může znamenat", 80), ("může být", 40))
_WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(s: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(s, f"^{_WHITE}+|{_WHITE}+$", "")


def is_paragraph(s: Column, low: int, high: int) -> Column:
    """A prose paragraph: opens plainly, ends a sentence, holds no markup, low to high words, at most a tenth of digits, is no disambiguation. Null and blank ones are none."""
    t = strip(F.coalesce(s, F.lit("")))
    words = F.size(F.filter(F.split(t, f"{_WHITE}+"), lambda w: w != ""))
    digits = F.char_length(F.regexp_replace(t, r"\P{Nd}", ""))
    ok = (t != "") & ~F.substring(t, 1, 1).isin(*BAD_START) & F.right(t, F.lit(1)).isin(*GOOD_END) & words.between(low, high) & (digits * 10 <= F.char_length(t))
    for mark in MARKS:
        ok &= ~F.contains(t, F.lit(mark))
    for lead, within in LEADS:
        ok &= ~F.contains(F.substring(t, 1, within), F.lit(lead))
    return ok


def sentences(s: Column, low: int = 5, high: int = 30) -> Column:
    """Sentences, cut at white space after a full stop, exclamation or question mark, of low to high words."""
    return F.filter(F.split(F.trim(s), r"(?<=[.!?])\s+"), lambda x: F.size(F.split(F.trim(x), r"\s+")).between(low, high))


def clean_lines(s: Column, most: int, low: int = 3, high: int = 200) -> Column:
    """Lines of a generated list without the bullets, numbers and brackets at both their ends, of low to high characters, the first `most`."""
    lines = F.transform(F.split(strip(s), "\n"), lambda x: F.regexp_replace(x, r"^[ \-•*0-9.)\t]+|[ \-•*0-9.)\t]+$", ""))
    return F.slice(F.filter(lines, lambda x: F.char_length(x).between(low, high)), 1, most)


def join_prompts(prompts: Column, sep: str) -> Column:
    """One string of many prompts; the separator inside a prompt becomes a space."""
    return F.array_join(F.transform(prompts, lambda x: F.replace(x, F.lit(sep), F.lit(" "))), sep)


#: Fixed value: the end of the names of files whose calibration is compared.
NAME_END = "-ps20000-t300k-ao-tabQ2_K"


def parse_file_name(name: Column, end: str = NAME_END) -> Column:
    """(model, grid, calib) of names like model-gptq-Q2_K-calib<end>.gguf; all null where a name is not of that kind."""
    p = r"^(.+?)-gptq-(Q[23]_K)-(.+?)" + end.replace(".", r"\.") + r"\.gguf$"
    return F.when(name.rlike(p), F.struct(*[F.regexp_extract(name, p, i + 1).alias(c) for i, c in enumerate(("model", "grid", "calib"))]))


def arm(calib: Column, dataset: Column) -> Column:
    """The arm of an experiment that a calibration text stands for; null for any other text."""
    own = lambda kind: F.concat(dataset, F.lit(f"_{kind}"))
    out = F.when(calib == "generic_wikitext", "generic_en").when(calib == "generic_cs", "generic_cs")
    return out.when(calib == own("corpus_only"), "corpus").when((calib == own("synth_only")) | (calib == own("synth_noleak")), "synth")


def log_number(line: Column, name: str) -> Column:
    """The number that follows `name =` in a log line, or null."""
    return F.regexp_extract(line, name + r"\s*=\s*([0-9.]+)", 1).try_cast("double")


#: Arms of the importance-matrix comparison by file type and calibration text.
IMATRIX_ARMS = {("IQ2_M", "generic_wikitext"): "A", ("IQ2_M", "scifact_corpus_only"): "B", ("Q2_K", "scifact_corpus_only"): "C", ("Q2_K", "generic_wikitext"): "D", ("Q2_K", "noimatrix"): "E", ("IQ2_XS", "scifact_corpus_only"): "F"}
IMATRIX_NAME = r"^[\w.-]+?-imx-([A-Z0-9_]+?)(pure)?-(.+)-tabQ2_K\.gguf$"


def describe_file(name: Column, budget: str) -> Column:
    """(tool, ftype, pure, calib, budget, arm) of a file of the importance-matrix comparison; every field is "?" (pure: false) where a name is of no known kind.

    The arm is a letter by type and calibration, with a prime for pure files; other pure files are "pure", other files "".
    """
    part = lambda i: F.regexp_extract(name, IMATRIX_NAME, i)
    known, pure, calib = name.rlike(IMATRIX_NAME), part(2) != "", part(3)
    letter = F.lit("")
    for (ftype, text), a in IMATRIX_ARMS.items():
        letter = F.when((part(1) == ftype) & (calib == text), a).otherwise(letter)
    arm_ = F.when(pure, F.when(letter != "", F.concat(letter, F.lit("'"))).otherwise("pure")).otherwise(letter)
    q = F.lit("?")
    fields = {"tool": F.lit("llama-quantize"), "ftype": part(1), "calib": calib, "budget": F.when(calib == "noimatrix", "—").otherwise(budget), "arm": arm_}
    return F.struct(*[F.when(known, v).otherwise(q).alias(k) for k, v in fields.items()], (known & pure).alias("pure"))


#: What calibration texts are.
CALIBRATION = {"corpus_only": "corpus documents (512-token windows)", "synth_only": "synthetic queries (doc2query, Qwen3-1.7B) in the {prompt}", "corpus_synth": "corpus documents + synthetic queries"}
CALIBRATION_TAG = r"^Q\d_K-([\w-]+?_(corpus_only|synth_only|corpus_synth))-ps(\d+)-t(\d+)k-ao-tab"


def describe_calibration(tag: Column, prompt: str = "E5 query format") -> Column:
    """A calibration in words, from a file's tag; the tag itself where it is of another kind."""
    part = lambda i: F.regexp_extract(tag, CALIBRATION_TAG, i)
    what = F.lit(None).cast("string")
    for kind, words in CALIBRATION.items():
        what = F.when(part(2) == kind, words.format(prompt=prompt)).otherwise(what)
    return F.when(tag.rlike(CALIBRATION_TAG), F.concat(part(1), F.lit(": "), what, F.lit(", per-sample, act-order, token budget "), part(4), F.lit("k"))).otherwise(tag)


def calibration_tokens(log: Column, window: int = 512) -> Column:
    """(sequences, tokens) of an export log: its line of sequences and tokens, else its number of windows times their length; null where it has neither."""
    first, second = r"\[calib\] \S+: (\d+) sequences = (\d+) tokens", r"n_seq=(\d+) per_sample"
    number = lambda p, i: F.regexp_extract(log, p, i).try_cast("long")
    both = lambda a, b: F.struct(a.alias("sequences"), b.alias("tokens"))
    return F.when(log.rlike(first), both(number(first, 1), number(first, 2))).when(log.rlike(second), both(number(second, 1), number(second, 1) * window))


def gpu_evidence(lines: Column, requested: Column) -> Column:
    """(adapter, offloaded, layers, buffers, errors, active, fallback) from the lines of a run's log: the first line of a kind, or all of them; active where an adapter was there and layers went to it."""
    pick = lambda p: F.transform(F.filter(lines, lambda x: x.rlike(p)), lambda x: F.trim(x))  # noqa: E731  trim alone would take the place as a second argument
    first = lambda p: F.try_element_at(pick(p), F.lit(1))
    adapter, offloaded = first("ggml_webgpu: adapter_info"), first(r"offloaded \d+/\d+ layers to GPU")
    at = lambda i: F.regexp_extract(offloaded, r"offloaded (\d+)/(\d+) layers", i)
    active = F.coalesce(adapter.isNotNull() & (at(1).try_cast("int") > 0), F.lit(False))
    return F.struct(
        adapter.alias("adapter"), offloaded.alias("offloaded"), F.when(offloaded.isNotNull(), F.concat(at(1), F.lit("/"), at(2))).alias("layers"), pick("model buffer size").alias("buffers"),
        pick("ggml_webgpu: (Failed|Device|Error)").alias("errors"), active.alias("active"), ((requested == "webgpu") & ~active).alias("fallback"),
    )
