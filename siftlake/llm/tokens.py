"""Token ids by a public tokenizer: an exact encoder that remembers the ids of each run that the pre-tokenizer makes."""

from __future__ import annotations

import array
import re
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A tokenizer file may be this large, so that it can be sent to every executor.
MAX_FILE_BYTES = 64 << 20
#: Runs that a worker remembers at most, in two generations, and their longest length.
MAX_RUNS, MAX_RUN = 700_000, 64
#: Characters of a text that are cut into runs at once.
CUT = 1 << 20

# Characters whose class needs no test: Latin letters, ASCII digits and marks, and common white space.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS} \n\r\t]*").fullmatch
#: The runs of a byte-level pre-tokenizer (a fixed value of its format) over these characters.
_RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+")
#: Where a run begins, whatever stands around it.
_BORDER = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9]|\n)").search


def tokenizer_file(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer's definition for the tasks; its size is checked, as every executor gets a copy."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has over {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(text)


def vocabulary_size(path: str | None = None) -> int:
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json")).get_vocab_size()


class _Remembered(dict):
    """What ``make`` gives for a key. Keys in use stay: when one generation is full, the one before it goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MAX_RUN:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class _Characters(dict):
    """Code point to what ``make`` gives for the character."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, point: int) -> str:
        self[point] = value = self.make(chr(point))
        return value


class Encoder:
    """Encodes a text to the bytes of its ids; with ``added_tokens`` equal to ``encode(text, add_special_tokens=False)``.

    A byte-level pre-tokenizer cuts a text into runs of letters, digits, other marks and white space, and each run is encoded by
    itself, so each distinct run is encoded only once while it is remembered (``most_runs``, in two generations). The class of a character outside of the common ones is asked of the
    pre-tokenizer. Strings of special tokens in a text count as ordinary text, unless ``added_tokens`` is true: then a text that holds
    one is encoded whole by the library. Other kinds of tokenizer get each text whole.
    """

    def __init__(self, definition: str, added_tokens: bool = False, most_runs: int = MAX_RUNS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added_tokens
        spec = json.loads(definition)
        self.added = [x["content"] for x in spec["added_tokens"]] if added_tokens else []
        pre = spec.get("pre_tokenizer") or {}
        self.by_run = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not [x for x in spec["added_tokens"] if not x["special"]]
        if self.by_run:
            self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
            # A byte-level pre-tokenizer writes each byte as a character of its own, which the model takes.
            self.written, self.classes = _Characters(lambda c: "".join(x for x, _ in self.split(c))), _Characters(self._like)
            self.runs = _Remembered(self._run, most_runs // 2)

    def _run(self, run: str) -> bytes:
        return array.array("I", [t.id for t in self.model.tokenize(run.translate(self.written))]).tobytes()

    def _like(self, character: str) -> str:
        """A plain character of the same class."""
        if _PLAIN(character):
            return character
        return next((x for x in "a1!" if len(self.split(x + character)) == 1), "\t")

    def _parts(self, text: str):
        """Parts of about CUT characters, cut where a run begins."""
        first = 0
        while len(text) - first > CUT and (border := _BORDER(text, first + CUT)):
            yield text[first : border.start()]
            first = border.start()
        yield text[first:] if first else text

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_run or any(map(text.__contains__, self.added)):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for part in self._parts(text):
            runs = _RUNS.findall(part) if _PLAIN(part) else (part[slice(*m.span())] for m in _RUNS.finditer(part.translate(self.classes)))
            out.append(b"".join(map(self.runs.__getitem__, runs)))
        return b"".join(out)


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(definition: Broadcast, added_tokens: bool = False, most_runs: int = MAX_RUNS) -> Encoder:
    """One encoder for each worker process and definition, kept from task to task with what it remembers."""
    key = definition.value, added_tokens, most_runs
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]
