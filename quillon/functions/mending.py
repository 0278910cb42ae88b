"""JSON that was cut off or written carelessly, made whole."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s*")
_RUN = re.compile(r"[^\s,:\[\]{}\"]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_NOTHING = object()
_CHUNK = {q: re.compile(rf"[^\\{q}]*") for q in "\"'"}
_HALF = re.compile("[\ud800-\udfff]")


def _no_constant(name: str):
    raise ValueError(name)


_WHOLE = json.JSONDecoder(parse_constant=_no_constant)
#: Lists and objects this deep are tried as whole ones first; deeper ones would be read too often.
_TRIED = 3


def _joined(parts: list[str]) -> str:
    """Halves of surrogate pairs are joined, a half without the other left out."""
    text = "".join(parts)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore") if _HALF.search(text) else text


class _Reader:
    """One pass over a text with a stack of open lists and objects."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def _string(self, quote: str) -> tuple[str, bool]:
        """The string that begins here, and does it end? A stray backslash stands for itself."""
        out, i, text = [], self.at + 1, self.text
        while i < len(text):
            run = _CHUNK[quote].match(text, i)
            if run.end() > i:
                out.append(run.group())
                i = run.end()
                continue
            c = text[i]
            if c == quote:
                self.at = i + 1
                return _joined(out), True
            follows = text[i + 1 : i + 2]
            code = text[i + 2 : i + 6]
            if follows == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                i += 6
            elif follows in _ESCAPES and follows:
                out.append(_ESCAPES[follows])
                i += 2
            elif not follows or follows == "u" and i + 2 + len(code) == len(text):
                break  # cut inside the escape
            else:
                out.append(c)
                i += 1
        self.at = len(text)
        return _joined(out), False

    def _plain(self):
        """A number or word; one that the text's end may have cut is nothing."""
        raw = _RUN.match(self.text, self.at).group()
        self.at += max(len(raw), 1)
        if raw in _WORDS:
            return _WORDS[raw]
        if not _NUMBER.fullmatch(raw) or self.at >= len(self.text):
            return _NOTHING
        return float(raw) if any(c in raw for c in ".eE") else int(raw)

    def _whole(self):
        """The list or object that begins here, where it is plain JSON to its end; halves of surrogate pairs aren't read this way."""
        try:
            value, end = _WHOLE.raw_decode(self.text, self.at)
        except (ValueError, RecursionError):
            return _NOTHING
        if "\\u" in self.text[self.at : end] or _HALF.search(self.text, self.at, end):
            return _NOTHING
        self.at = end
        return value

    def read(self):
        stack: list[tuple[list | dict, list]] = []  # what is open, and its pending key where it is an object
        done, single = _NOTHING, _NOTHING  # the first list or object, and what stood before it
        while True:
            c = self._skip()
            if not c:
                break
            top, key = stack[-1] if stack else (None, [])
            if c in "]}":
                self.at += 1
                if stack:
                    closed = stack.pop()[0]
                    if not stack:
                        return closed
                continue
            if c in ",:":
                self.at += 1
                continue
            if isinstance(top, dict) and not key:
                if c in "\"'":
                    name, whole = self._string(c)
                    if not whole:
                        break
                    key.append(name)
                else:
                    self.at += 1
                continue
            opened = False
            if c in "[{":
                value: object = self._whole() if len(stack) < _TRIED else _NOTHING
                if value is not _NOTHING and not stack:
                    return value
                if value is _NOTHING:
                    self.at += 1
                    value, opened = [] if c == "[" else {}, True
            elif c in "\"'":
                value = self._string(c)[0]
            else:
                value = self._plain()
            if value is not _NOTHING:
                if isinstance(top, list):
                    top.append(value)
                elif isinstance(top, dict):
                    top[key.pop()] = value
            elif key:
                key.pop()
            if opened:
                stack.append((value, []))
                if done is _NOTHING:
                    done = value
            elif not stack and single is _NOTHING:
                single = value
        return single if done is _NOTHING else done


def mend(text: str | None) -> str | None:
    """JSON text of what ``text`` holds; null where it holds nothing.

    Open strings, lists and objects end where the text does. A number or word that may have been cut,
    a key without a value and what can't be read are left out; commas too many or too few, single quotes
    and stray backslashes are put right. The first list or object counts, whatever stands around it.
    """
    if text is None:
        return None
    value = _Reader(text).read()
    return None if value is _NOTHING else json.dumps(value)


@F.arrow_udf(T.StringType())
def _mended(texts: pa.Array) -> pa.Array:
    return pa.array([mend(t) for t in texts.to_pylist()], pa.string())


def unfenced(raw: Column) -> Column:
    r"""What stands in the first pair of code fences, else the whole text; backslashes that begin no escape are doubled."""
    fence = F.when(F.contains(raw, F.lit("```json")), "```json").when(F.contains(raw, F.lit("```")), "```")
    inside = F.try_element_at(F.split(raw, F.concat(F.lit("\\Q"), fence, F.lit("\\E")), -1), F.lit(2))
    body = F.when(fence.isNotNull(), F.substring_index(inside, "```", 1)).otherwise(raw)
    return F.regexp_replace(F.trim(body), r'\\(?!["\\/bfnrtu])', r"\\\\")


def parsed(df: DataFrame, raw: str, schema: str, column: str) -> DataFrame:
    """The rows with ``column``, the JSON of ``raw``; only rows that Spark's parser refuses go through ``mend``.

    Texts that hold nothing of the schema give null.
    """
    first = df.withColumn(column, F.from_json(raw, schema))
    refused = F.when(F.col(column).isNull(), F.col(raw))
    mended = first.withColumn("__raw", _mended(refused))
    return mended.select(*df.columns, F.coalesce(column, F.from_json("__raw", schema)).alias(column))
