"""Sentence segmentation as one regular expression and a fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.binding import let
from folioflow.functions.cleaning import LOWER

# fixed values
ABBREVIATIONS = [
    "dr", "prof", "doç", "doc", "yrd", "av", "sn", "st", "vb", "vs", "vd", "örn", "bkz", "no", "nr", "s", "sf", "ss", "c", "haz", "çev", "ed", "mah", "cad", "sok", "apt",
    "tel", "alb", "yzb", "bnb", "org", "gen", "kur", "ltd", "şti", "hz", "mr", "mrs", "ms", "bay", "bayan", "op", "uzm", "ord", "müh",
]
LONGEST = 900
CLOSERS = "[\"'”»’)\\]]*"
MARK = "﷐"


def _either_case(word: str) -> str:
    """A pattern for a word in default lower-casing: capitals whose lower case is the letter."""
    return "".join(f"[{c}{c.upper()}]" if c.upper().lower() == c and len(c.upper()) == 1 else c for c in word)


def boundary_pattern() -> str:
    """A terminator with its word and closers that ends a sentence, and the spaces after it.

    A full stop does not end one after an abbreviation, a word with a stop inside, a
    single capital, or one or two digits before a capital. No terminator does before a
    lower-case letter or , ; :. The word before a stop is matched from its start, so that every
    character is looked at a bounded number of times.
    """
    held = "|".join([*(_either_case(a) for a in ABBREVIATIONS), r"(?=\p{L})\p{IsUppercase}"])
    word = rf"(?<![\w.])(?!(?:{held})\.)(?!\d{{1,2}}\.[.!?]*{CLOSERS}\x20+\p{{IsUppercase}})\w++"
    return rf"(?sU)((?:(?:{word}|(?<![\w.!?]))\.[.!?]*|(?<![.!?])[!?][.!?]*|…){CLOSERS})\x20+(?=[^\x20{LOWER},;:])"


def split_sentences(text: Column) -> Column:
    """Sentences of a paragraph as an array of strings; over-long ones are cut.

    Spaces after a terminator or closer and before a possible beginning are marked first, by a pattern that starts at the
    space. Whether such a place ends a sentence depends on the word before it and the letter after it alone, so ``boundary_pattern`` looks at these only.
    """
    blank = r"(?U)[\s\x1c-\x1f]+"
    possible = rf"(?s)\x20(?<=[.!?…\"'”»’)\]]\x20)(\x20*+)(?=[^\x20{LOWER},;:])"

    def ends(before: Column, after: Column) -> Column:
        return F.concat(F.substring_index(before, " ", -1), F.lit(" "), F.left(F.ltrim(after), F.lit(1))).rlike(boundary_pattern())

    def marked(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(ends(F.get(parts, i - 1), p), MARK).otherwise(""), p)))

    def pieces(raw: Column) -> Column:
        last = F.size(raw) - 1
        clean = F.transform(raw, lambda s, i: F.regexp_replace(F.when(i == last, F.regexp_replace(s, f"{blank}$", "")).otherwise(s), rf"(?U)\A[\s\x1c-\x1f]+", ""))
        return F.flatten(F.transform(F.filter(clean, lambda s: s != ""), lambda s: cut_long(s)))

    parts = F.split(F.regexp_replace(text, possible, f"{MARK} $1"), MARK)
    return let(F.split(F.array_join(let(parts, marked), ""), MARK), pieces)


def cut_long(sentence: Column, longest: int = LONGEST) -> Column:
    """Pieces of at most ``longest`` characters, cut after the last "; " or ", " of the window, or after a space if that lies in the first third.

    The fold keeps where the rest starts; a window without a space ends the cutting.
    """

    def last_of(window: Column, mark: str) -> Column:
        back = F.instr(F.reverse(window), mark[::-1])
        return F.when(back > 0, F.length(window) - back - len(mark) + 1).otherwise(-1)

    def place(window: Column) -> Column:
        clause = F.greatest(last_of(window, "; "), last_of(window, ", "))
        return F.when(clause < longest // 3, last_of(window, " ")).otherwise(clause)

    def state_of(at: Column, pieces: Column, more: Column) -> Column:
        return F.struct(at.alias("at"), pieces.alias("pieces"), more.alias("open"))

    def cut(state: Column, at: Column) -> Column:
        piece = F.substring(sentence, state["at"], at + 1)
        rest = F.substring(sentence, state["at"] + at + 1, F.lit(longest))
        gap = F.length(rest) - F.length(F.ltrim(rest))
        return F.when(at > 0, state_of(state["at"] + at + 1 + gap, F.concat(state["pieces"], F.array(piece)), F.lit(True))).otherwise(state_of(state["at"], state["pieces"], F.lit(False)))

    def step(state: Column, _: Column) -> Column:
        long = state["open"] & (F.length(sentence) - state["at"] + 1 > longest)
        return F.when(long, let(let(F.substring(sentence, state["at"], F.lit(longest)), place), lambda at: cut(state, at))).otherwise(state)

    start = state_of(F.lit(1), F.array().cast("array<string>"), F.lit(True))
    # a cut in the window's first third leaves two thirds without a mark, so two cuts in a row pass more than half a window
    rounds = F.sequence(F.lit(1), F.floor(F.length(sentence) * 4 / longest).cast("int") + 3)
    done = F.aggregate(rounds, start, step, lambda s: F.concat(s["pieces"], F.array(F.substring(sentence, s["at"], F.length(sentence)))))
    return F.when(F.length(sentence) <= longest, F.array(sentence)).otherwise(done)
