"""LaTeX texts: environments, brace arguments, conversion, inventories.

A text is converted inside its row, so a corpus needs no shuffle for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import let, strip
from scholia.vocab import (
    HEADING_MARKS, INLINE_MARKS, PROTECTED_ENVIRONMENTS, REFERENCE_MARKS, SPECIAL_CHARACTERS,
)

ENVIRONMENT = r"\\(begin|end)\{(\w+)\*?\}"
# places in the text, and numbers of the pieces that hold the two marks
_SPANS = "array<struct<name:string,start:int,end:int,first:int,last:int>>"
_OPEN = "array<struct<name:string,start:int,first:int,had:int>>"
_STATE = f"struct<at:int,stack:{_OPEN},kept:int,spans:{_SPANS}>"
_ARGUMENTS = "array<struct<first:int,last:int,again:boolean>>"
_CALLS = f"struct<depth:int,left:int,first:int,again:boolean,kept:int,spans:{_ARGUMENTS}>"
#: Pieces in one inner fold.
_RUN = 256


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its tokens: what is before the first, the first token, and so on; the last token is empty.

    Piece i is the text before token i and that token. Spans of pieces are put together
    by slices of this array, so that a fold over the tokens never copies text.
    """
    tokens = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.flatten(F.zip_with(F.split(text, pattern, -1), tokens, lambda before, token: F.array(before, token)))


def _fold(pieces: Column, zero: Column, spans: str, step, finish) -> Column:
    """``finish(spans)`` of a fold over the numbers of the pieces; ``step(state, i, before, token)``.

    Spark copies the whole state at every step. So runs of pieces are folded with
    the spans they find only, and an outer fold puts together the spans of the runs.
    ``kept`` in the state is how many spans of earlier runs still stand.
    """
    none = F.array().cast(spans)
    last = (F.size(pieces) / 2 - 1).cast("int")

    def run(whole: Column, begin: Column) -> Column:
        numbers = F.sequence(begin, F.least(begin + (_RUN - 1), last))
        joined = lambda s: F.concat(F.slice(whole.spans, F.lit(1), s.kept), s.spans)
        after = lambda s: F.struct(
            s.withField("kept", s.kept + F.size(s.spans)).withField("spans", none).alias("state"), joined(s).alias("spans")
        )
        return F.aggregate(numbers, whole.state, lambda s, i: step(s, i, F.get(pieces, 2 * i), F.get(pieces, 2 * i + 1)), after)

    start = F.struct(zero.alias("state"), none.alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), last, F.lit(_RUN)), start, run, lambda whole: finish(whole.spans))


def _up_to(pieces: Column, spans: Column, i: Column) -> Column:
    """The text between the span before the i-th and the i-th, or to the end."""
    begin = F.when(i > 0, F.get(spans, i - 1)["last"] + 1).otherwise(0)
    end = F.coalesce(2 * F.get(spans, i)["first"] + 1, F.size(pieces))
    return F.array_join(F.slice(pieces, 2 * begin + 1, F.greatest(end - 2 * begin, F.lit(0))), "")


def _environments(pieces: Column, finish) -> Column:
    """``finish(spans)`` of the outermost matched environments.

    An open environment knows how many spans there were before it, which is what is left of
    them once it is closed, so a step costs no look at the spans.
    """
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast(_OPEN).alias("stack"), F.lit(0).alias("kept"), F.array().cast(_SPANS).alias("spans"),
    )

    def step(state: Column, i: Column, before: Column, token: Column) -> Column:
        start = state.at + F.length(before)
        end = start + F.length(token)
        name = F.regexp_extract(token, ENVIRONMENT, 2)
        opens, top = token.startswith("\\begin"), F.get(state.stack, F.lit(0))
        closes = token.startswith("\\end") & F.coalesce(top["name"] == name, F.lit(False))
        opened = F.struct(name.alias("name"), start.alias("start"), i.alias("first"), (state.kept + F.size(state.spans)).alias("had"))
        closed = F.struct(
            top["name"].alias("name"), top["start"].alias("start"), end.alias("end"), top["first"].alias("first"), i.alias("last"),
        )
        outer = F.slice(state.spans, F.lit(1), F.greatest(top.had - state.kept, F.lit(0)))
        return F.struct(
            end.alias("at"),
            F.when(opens, F.concat(F.array(opened), state.stack))
            .when(closes, F.slice(state.stack, 2, 1_000_000)).otherwise(state.stack).alias("stack"),
            F.when(closes, F.least(top.had, state.kept)).otherwise(state.kept).alias("kept"),
            F.when(closes, F.concat(outer, F.array(closed))).otherwise(state.spans).alias("spans"),
        )

    return _fold(pieces, zero.cast(_STATE), _SPANS, step, finish)


def _block(pieces: Column, span: Column) -> Column:
    """Text of a span with its two marks."""
    size = 2 * (span["last"] - span["first"]) + 1
    return F.array_join(F.slice(pieces, 2 * span["first"] + 2, size), "")


def environment_spans(text: Column) -> Column:
    """Outermost matched environments as ``(name, start, end)``, offsets from 0.

    An end closes the innermost open environment if the names agree and is
    ignored otherwise.
    """
    place = lambda s: F.struct(s["name"].alias("name"), s.start.alias("start"), s.end.alias("end"))
    return let(_pieces(text, ENVIRONMENT), lambda p: _environments(p, lambda spans: F.transform(spans, place)))


def top_level_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per outermost environment, with its text and whether it is protected."""

    def cut(pieces: Column) -> Column:
        return _environments(pieces, lambda spans: F.transform(spans, lambda s: F.struct(
            s["name"].alias("name"), s.start.alias("start"), s.end.alias("end"), _block(pieces, s).alias("block")
        )))

    rows = df.select(key, F.posexplode(let(_pieces(F.col(text), ENVIRONMENT), cut)).alias("pos", "_s"))
    return rows.select(
        key, "pos", F.col("_s.name").alias("name"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"),
        F.col("_s.name").isin(PROTECTED_ENVIRONMENTS).alias("protected"), F.col("_s.block").alias("block"),
    )


def balanced(text: Column, command: str, arguments: int = 1) -> Column:
    """Struct of the text without ``\\command{..}`` and the arguments removed, see :func:`balanced_calls`."""
    return balanced_calls(text, {command: arguments})


def balanced_calls(text: Column, commands: dict[str, int]) -> Column:
    """Struct of the text without calls of the commands and the arguments removed; commands with their most arguments.

    Braces are counted, so arguments may nest; an unclosed one runs to the end.
    With two arguments the second is optional and may follow white space. The braces
    are walked once and the text is put together once, at the end.
    """
    openings = {"\\" + name + "{": most for name, most in commands.items()}
    further = lambda token: reduce(lambda rest, x: F.when(token == x[0], x[1] - 1).otherwise(rest), openings.items(), F.lit(0))
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("left"), F.lit(0).alias("first"), F.lit(False).alias("again"),
        F.lit(0).alias("kept"), F.array().cast(_ARGUMENTS).alias("spans"),
    ).cast(_CALLS)

    def step(s: Column, i: Column, before: Column, token: Column) -> Column:
        inside = s.depth > 0
        is_call, is_open, is_close = token.isin(list(openings)), token == "{", token == "}"
        starts = ~inside & is_call
        again = ~inside & is_open & (s.left > 0) & (strip(before) == "")
        ends = inside & ((is_close & (s.depth == 1)) | (token == ""))
        span = F.struct(s["first"].alias("first"), i.alias("last"), s.again.alias("again"))
        return F.struct(
            F.when(starts | again, 1)
            .when(inside & (is_call | is_open), s.depth + 1)
            .when(inside & is_close, s.depth - 1)
            .otherwise(s.depth).alias("depth"),
            F.when(starts, further(token)).when(again, s.left - 1).when(inside, s.left).otherwise(0).alias("left"),
            F.when(starts | again, i).otherwise(s["first"]).alias("first"),
            F.when(starts | again, again).otherwise(s.again).alias("again"),
            s.kept.alias("kept"),
            F.when(ends, F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"),
        )

    def result(pieces: Column, spans: Column) -> Column:
        gap = lambda s, i: F.when(s.again, F.lit("")).otherwise(_up_to(pieces, spans, i))
        inner = lambda s: F.array_join(F.slice(pieces, 2 * s["first"] + 3, 2 * (s["last"] - s["first"]) - 1), "")
        text = F.concat(F.array_join(F.transform(spans, gap), ""), _up_to(pieces, spans, F.size(spans)))
        return F.struct(text.alias("text"), F.transform(spans, inner).alias("args"))

    names = "|".join(commands)
    return let(_pieces(text, rf"\\(?:{names})\{{|\{{|\}}"), lambda p: _fold(p, zero, _ARGUMENTS, step, lambda spans: result(p, spans)))


def balanced_args(df: DataFrame, key: str, text: str, command: str, arguments: int = 1) -> DataFrame:
    """One row per argument of the command, in order."""
    args = F.when(F.contains(text, F.lit("\\" + command + "{")), balanced(F.col(text), command, arguments)["args"])
    return df.select(key, F.posexplode(args).alias("pos", "argument"))


def _without(text: Column, commands: dict[str, int]) -> Column:
    """Removes commands with their arguments in one walk; texts without them are not scanned."""
    found = lambda t: reduce(lambda x, y: x | y, (F.contains(t, F.lit("\\" + c + "{")) for c in commands))
    return let(text, lambda t: F.when(found(t), balanced_calls(t, commands)["text"]).otherwise(t))


def _replace_each(text: Column, pattern: str, render) -> Column:
    """Replaces every match by ``render(group 1)``."""
    parts = lambda t: F.struct(
        F.split(t, pattern, -1).alias("gaps"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("inner"),
    )
    put = lambda v: F.transform(
        v.gaps, lambda b, i: F.concat(b, F.coalesce(render(F.get(v.inner, i)), F.lit("")))
    )
    return let(let(text, parts), lambda v: F.array_join(put(v), ""))


def _items(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"\\item\s*"), strip), lambda i: i != "")


def _itemize(content: Column) -> Column:
    marked = F.transform(_items(content), lambda i: F.concat(F.lit("- "), i))
    return F.concat(F.array_join(marked, "\n"), F.lit("\n\n"))


def _enumerate(content: Column) -> Column:
    marked = F.transform(_items(content), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.array_join(marked, "\n"), F.lit("\n\n"))


def _substitute(text: Column, rules) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


# --- fixed values: commands that are rewritten or dropped ----------------------
_END = r"(?![A-Za-z])"
METADATA_RULES = [
    (rf"\\(?:maketitle|IEEEpeerreviewmaketitle){_END}", ""),
    (r"(?s)\\(?:bibliographystyle|bibliography|IEEEpubid|IEEEaftertitletext)\{.*?\}", ""),
    (r"(?s)\\begin\{IEEEkeywords\}.*?\\end\{IEEEkeywords\}", ""),
]
INLINE_RULES = [
    (rf"(?s)\\{name}\{{(.*?)\}}", f"{before}$1{after}")
    for name, (before, after) in ((n, (m[0].replace("$", r"\$"), m[1])) for n, m in INLINE_MARKS.items())
]
REFERENCE_RULES = [
    (rf"\\{name}" + (r"(?:\[.*?\])?" if name == "cite" else "") + r"\{.*?\}", mark)
    for name, mark in REFERENCE_MARKS.items()
]
LEFTOVER_RULES = [
    (r"\\(?:enspace|quad|qquad|hfill|vspace\*?|hspace\*?)\{.*?\}", ""),
    (rf"\\(?:enspace|quad|qquad|hfill|vfill){_END}", ""),
    (rf"\\newline{_END}|\\\\\s*", "\n"),
    (rf"\\(?:noindent|small|normalsize|footnotesize|scriptsize|tiny|hrule|centering){_END}", ""),
    (r"\\(?:pgfplotsset|usepgfplotslibrary|usetikzlibrary|hyphenation)\{.*?\}", ""),
    (r"\\setlength\{.*?\}\{.*?\}", ""),
    (r"\\MakeLowercase\{(.*?)\}", "$1"),
    (r"\\IEEEPARstart\{.*?\}\{.*?\}", ""),
    (r"\\and\s+", " "),
    (r"(?s)\\begin\{IEEEbiographynophoto\}.*?\\end\{IEEEbiographynophoto\}", ""),
]


def document_body(text: Column) -> Column:
    """Text between the document markers; without them the whole text."""
    after = F.regexp_replace(text, r"(?s)^.*?\\begin\{document\}", "")
    return F.regexp_replace(after, r"(?s)\\end\{document\}.*$", "")


def drop_comments(text: Column) -> Column:
    """Unescaped percent signs to the end of the line; escaped ones stay as a sign."""
    cut = F.regexp_replace(text, r"(?m)(?<!\\)%[^\n]*$", "")
    return F.replace(cut, F.lit("\\%"), F.lit("%"))


def _protect(text: Column) -> Column:
    """Struct of the text with numbered marks and the protected blocks."""

    def marked(pieces: Column, spans: Column) -> Column:
        mark = lambda i: F.concat(F.lit("\u0000"), i.cast("string"), F.lit("\u0000"))
        gaps = F.transform(spans, lambda s, i: F.concat(_up_to(pieces, spans, i), mark(i)))
        return F.struct(
            F.concat(F.array_join(gaps, ""), _up_to(pieces, spans, F.size(spans))).alias("text"),
            F.transform(spans, lambda s: _block(pieces, s)).alias("blocks"),
        )

    kept = lambda spans: F.filter(spans, lambda s: s["name"].isin(PROTECTED_ENVIRONMENTS))
    return let(_pieces(text, ENVIRONMENT), lambda p: let(_environments(p, kept), lambda spans: marked(p, spans)))


def _convert(text: Column) -> Column:
    abstract = lambda a: F.concat(F.lit("# Abstract\n\n"), strip(a), F.lit("\n\n"))
    text = _replace_each(text, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", abstract)
    text = _substitute(text, METADATA_RULES)
    for name in sorted(HEADING_MARKS, key=len, reverse=True):
        heading = lambda h, m=HEADING_MARKS[name]: F.concat(F.lit(m), strip(h), F.lit("\n\n"))
        text = _replace_each(text, rf"(?s)\\{name}\*?\{{(.*?)\}}", heading)
    text = _substitute(text, INLINE_RULES)
    text = _substitute(text, REFERENCE_RULES)
    note = lambda n: F.concat(F.lit(" ("), strip(n), F.lit(") "))
    text = _replace_each(text, r"(?s)\\footnote\{(.*?)\}", note)
    text = _replace_each(text, r"(?s)\\begin\{itemize\}(.*?)\\end\{itemize\}", _itemize)
    text = _replace_each(text, r"(?s)\\begin\{enumerate\}(.*?)\\end\{enumerate\}", _enumerate)
    for escape, plain in SPECIAL_CHARACTERS.items():
        if escape[-1].isalpha():
            text = F.regexp_replace(text, "\\" + escape + _END, plain.replace("\\", "\\\\"))
        else:
            text = F.replace(text, F.lit(escape), F.lit(plain))
    text = F.replace(text, F.lit("~"), F.lit(" "))
    text = _without(text, {"title": 1, "author": 1, "thanks": 1, "IEEEmembership": 1})
    return _without(_substitute(text, LEFTOVER_RULES), {"markboth": 2, "resizebox": 1})


def tex_to_text(tex: Column) -> Column:
    """LaTeX source to plain text; figures, tables and formulas stay as they are."""

    def restored(v: Column) -> Column:
        block = lambda i: F.get(v.blocks, i.try_cast("int"))
        return _replace_each(_convert(v.text), r"\x00(\d+)\x00", block)

    whole = let(let(drop_comments(document_body(tex)), _protect), restored)
    whole = F.regexp_replace(whole, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(whole, r" +\n", "\n"))


def section_inventory(df: DataFrame, key: str, tex: str) -> DataFrame:
    """``(key, pos, command, level, heading)`` of all headings in order."""
    names = "|".join(sorted(HEADING_MARKS, key=len, reverse=True))
    pattern = rf"(?s)\\({names})\*?\{{(.*?)\}}"
    rows = df.select(key, F.posexplode(F.regexp_extract_all(tex, F.lit(pattern), F.lit(0))).alias("pos", "_h"))
    levels = F.create_map(*[F.lit(x) for n, m in HEADING_MARKS.items() for x in (n, len(m.strip()))])
    rows = rows.withColumn("command", F.regexp_extract("_h", pattern, 1))
    heading = strip(F.regexp_extract("_h", pattern, 2))
    return rows.select(key, "pos", "command", levels[F.col("command")].alias("level"), heading.alias("heading"))


_REFERENCE = r"\\(" + "|".join(REFERENCE_MARKS) + r")(?:\[[^\]]*\])?\{(.*?)\}"


def citations(df: DataFrame, key: str, tex: str) -> DataFrame:
    """``(key, kind, cited)``: one row per key named by a reference command."""
    rows = df.select(key, F.explode(F.regexp_extract_all(tex, F.lit(_REFERENCE), F.lit(0))).alias("_r"))
    rows = rows.select(key, F.regexp_extract("_r", _REFERENCE, 1).alias("kind"), F.regexp_extract("_r", _REFERENCE, 2).alias("_k"))
    return rows.select(key, "kind", F.explode(F.split("_k", ",")).alias("cited")).withColumn("cited", strip(F.col("cited")))


def citation_counts(df: DataFrame, key: str, tex: str) -> DataFrame:
    """Reference commands per document and kind."""
    rows = df.select(key, F.explode(F.regexp_extract_all(tex, F.lit(_REFERENCE), F.lit(1))).alias("kind"))
    return rows.groupBy(key, "kind").agg(F.count("*").alias("uses"))
