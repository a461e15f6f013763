"""Extractors that need a parser: they run in Python over batches of files and only parse, never execute."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
import warnings
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_TOKENS = 40


def per_file(files: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, columns: tuple[str, ...] = ("path", "src")) -> DataFrame:
    """The rows that fn yields for each file, called with `columns`."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for args in zip(*(b[c] for c in columns), strict=True) for r in fn(*args)]
            yield pd.DataFrame(rows, columns=names)

    return files.select(*columns).mapInPandas(run, schema)


def parsed(src: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(src or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOP = (ast.For, ast.AsyncFor, ast.While)
_CONTEXT = (ast.With, ast.AsyncWith)
_BRANCHING = (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler, ast.comprehension, *_LOOP, *_CONTEXT)
_NESTS = (ast.If, ast.Try, ast.ClassDef, *_LOOP, *_CONTEXT, *_FUNCTION)


def python_complexity(path: str, src: str | None) -> Iterator[tuple]:
    """path, loc, cc, depth, funcs, raw of parseable Python; nothing for the rest."""
    tree = parsed(src)
    if tree is None:
        return
    cc, depth, funcs, todo = 1, 0, 0, [(tree, 0)]
    while todo:
        node, level = todo.pop()
        depth = max(depth, level)
        cc += isinstance(node, _BRANCHING)
        cc += len(node.values) - 1 if isinstance(node, ast.BoolOp) else len(node.cases) if isinstance(node, ast.Match) else 0
        funcs += isinstance(node, _FUNCTION)
        todo += [(c, level + isinstance(c, _NESTS)) for c in ast.iter_child_nodes(node)]
    bare = [x.strip() for x in (src or "").splitlines()]
    loc = sum(bool(x) and x[0] != "#" for x in bare)
    yield path, loc, cc, depth, funcs, round(cc + 0.05 * loc + 1.5 * depth, 1)


_TRIVIA = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
_LITERAL = {tokenize.STRING, tokenize.NUMBER}
#: Since f-strings are tokens of their own, their parts count as one literal each, as whole strings do.
_PIECES = {getattr(tokenize, n) for n in ("FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, n)}


def python_tokens(segment: str) -> list[str]:
    """Tokens with names and literals erased; nothing if they can't be read."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(segment).readline):
            if t.type in _TRIVIA:
                continue
            name = t.type == tokenize.NAME and not keyword.iskeyword(t.string)
            out.append("LIT" if t.type in _LITERAL or t.type in _PIECES else "ID" if name else t.string)
    except (tokenize.TokenError, SyntaxError):
        return []
    return out


def python_functions(path: str, src: str | None) -> Iterator[tuple]:
    """path, name, line, end, loc, toks of every function of at least MIN_TOKENS tokens, outer ones first."""
    tree = parsed(src)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, _FUNCTION) and (segment := ast.get_source_segment(src, node)):
            toks = python_tokens(segment)
            if len(toks) >= MIN_TOKENS:
                yield path, node.name, node.lineno, node.end_lineno or node.lineno, segment.count("\n") + 1, toks


def python_symbols(path: str, src: str | None) -> Iterator[tuple]:
    """path, symbol of public top-level functions and classes."""
    tree = parsed(src)
    for node in tree.body if tree else ():
        if isinstance(node, (*_FUNCTION, ast.ClassDef)) and node.name[0] != "_":
            yield path, node.name


def python_imports(package: list[str], src: str | None, tops: frozenset[str], package_init: bool = False) -> Iterator[list[str]]:
    """Dotted names, as parts, that a module of `package` imports and that may be of this repository.

    Absolute names must begin with one of `tops`; other names may be siblings. A relative import counts its dots from
    the module's package, which for a package's own __init__ is that package (package_init).
    """
    tree = parsed(src)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            for parts in (a.name.split(".") for a in node.names):
                yield parts if parts[0] in tops else package + parts
        elif isinstance(node, ast.ImportFrom):
            stem = node.module.split(".") if node.module else []
            if node.level:
                up = node.level - 1
                stem = package[: max(0, len(package) - up)] + stem
                if not stem or stem[0] not in tops:
                    continue
            elif stem and stem[0] not in tops:
                stem = package + stem
            for a in node.names:
                yield [*stem, *a.name.split(".")]
            if stem:
                yield stem


# --- scripts ---------------------------------------------------------------------------------------------------------

_SCRIPT_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<lit>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)n?)|"""
    r"""(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>>>>=|===|!==|\*\*=|<<=|>>=|>>>|\.\.\.|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>|.)""",
    re.S,
)
_WORDS = frozenset(
    "abstract any as asserts async await bigint boolean break case catch class const constructor continue debugger declare default delete do else enum export "
    "extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number object of "
    "package private protected public readonly require return set static string super switch symbol this throw true try type typeof undefined unique unknown var void while with yield".split()
)
_CONTROL = frozenset("if for while switch catch with return function".split())


def script_tokens(text: str) -> list[tuple[str, str, int]]:
    """Normal form, text and place of each token of a script."""
    out = []
    for m in _SCRIPT_TOKEN.finditer(text):
        if m.lastgroup != "skip":
            raw = m[0]
            out.append(("LIT" if m.lastgroup == "lit" else "ID" if m.lastgroup == "name" and raw not in _WORDS else raw, raw, m.start()))
    return out


def _closing(toks: list, at: int) -> int:
    """Where the bracket that opens at `at` closes."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for k in range(at, len(toks)):
        depth += (toks[k][0] in pairs) - (toks[k][0] in pairs.values())
        if depth == 0:
            return k
    return len(toks) - 1


def script_functions(path: str, src: str | None) -> Iterator[tuple]:
    """path, name, line, end, loc, toks of functions, methods and arrow functions of at least MIN_TOKENS tokens.

    No script parser is at hand: functions are found by their brackets, which reads ordinary code well but not every form of the language
    (regular expressions that hold quotes or brackets, nested templates). A table extracted by a compiler can be used instead.
    """
    src = src or ""
    toks = script_tokens(src)
    for i, (form, raw, _) in enumerate(toks):
        name, start, end = None, i, None
        if raw == "function":
            k = i + 1 + (i + 1 < len(toks) and toks[i + 1][1] == "*")
            if k < len(toks) and toks[k][0] == "ID":
                name, k = toks[k][1], k + 1
            elif i > 1 and toks[i - 1][1] in ("=", ":"):
                name = toks[i - 2][1]
            while k < len(toks) and toks[k][1] != "(":
                k += 1
            end = _body(toks, k)
            start = i - (i > 0 and toks[i - 1][1] == "async")
        elif raw == "=>":
            open_ = i - 1
            if toks[i - 1][1] == ")":
                depth = 0
                while open_ >= 0:
                    depth += (toks[open_][1] == ")") - (toks[open_][1] == "(")
                    if depth == 0:
                        break
                    open_ -= 1
            start = max(0, open_)
            if start > 0 and toks[start - 1][1] == "async":
                start -= 1
            name = toks[start - 2][1] if start > 1 and toks[start - 1][1] in ("=", ":") else None
            if i + 1 < len(toks) and toks[i + 1][1] == "{":
                end = _closing(toks, i + 1)
            else:
                end, depth = i + 1, 0
                while end < len(toks):
                    depth += (toks[end][1] in "([{") - (toks[end][1] in ")]}")
                    if depth < 0 or (depth == 0 and toks[end][1] in (";", ",")):
                        break
                    end += 1
                end -= 1
        elif form == "ID" and i + 1 < len(toks) and toks[i + 1][1] == "(" and raw not in _CONTROL and (i == 0 or toks[i - 1][1] in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "*")):
            end = _body(toks, i + 1, method=True)
            name = raw
        if end is None or end >= len(toks):
            continue
        own = [t[0] for t in toks[start : end + 1]]
        if len(own) >= MIN_TOKENS:
            a, z = toks[start][2], toks[end][2] + len(toks[end][1])
            line = src.count("\n", 0, a) + 1
            yield path, name or "<anon>", line, src.count("\n", 0, z) + 1, src.count("\n", a, z) + 1, own


def _body(toks: list, at: int, method: bool = False) -> int | None:
    """The end of the braces that follow a parameter list and an optional return type; None if there are none."""
    if at >= len(toks):
        return None
    k = _closing(toks, at) + 1
    if k < len(toks) and toks[k][1] == ":":
        depth = 0
        while k < len(toks) and not (toks[k][1] == "{" and depth == 0 and toks[k - 1][1] not in (":", "|", "&")):
            if toks[k][1] in (";", "="):
                return None
            depth += (toks[k][1] in "(<[") - (toks[k][1] in ")>]")
            k += 1
    return _closing(toks, k) if k < len(toks) and toks[k][1] == "{" else None
