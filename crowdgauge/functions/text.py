"""Text functions as Column expressions. They stay in the JVM; the two Python helpers live in
``functions.python_text``."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Input patterns (tags, handles, links, emoji codes of the landing texts).
LATIN_TERM = r"^[0-9a-z&.\- ]+$"
SPACES = r"(?U)[\s\x1c-\x1f]+"
# What is no letter, digit or CJK character, by its ranges: matching a negated class costs twice as much and more.
NO_WORD = r"[\x00-/:-`{-\x{10ffff}]+"
NO_WORD_OR_CJK = r"[\x00-/:-`{-\u4dff\ua000-\x{10ffff}]+"
NO_WORD_OR_CJK_ANY_CASE = r"[\x00-/:-@\[-`{-\u4dff\ua000-\x{10ffff}]+"
TOPIC_TAG = r"#[^#\n]{0,40}\[话题\]#"
TAG_MARK = r"\[话题\]#"
HASHTAG = r"(?U)#[^#\n]{0,40}\[话题\]#|#[^\s#]{1,30}"
HANDLE = r"(?U)@[^\s@]{1,20}"
EMOJI_TAG = r"\[[^\[\]\n]{1,12}\]"
URL = r"(?U)https?://\S+"
CJK = "[一-鿿]"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; filters and lambdas share no common parts."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


@lru_cache(maxsize=1)
def _width_table() -> tuple[str, str]:
    """Full-width forms and wide spaces whose compatibility form is one character, by rule."""
    source, target = [], []
    for code in (0x00A0, 0x3000, *range(0xFF01, 0xFFEF)):
        folded = unicodedata.normalize("NFKC", chr(code))
        if len(folded) == 1 and folded != chr(code):
            source.append(chr(code))
            target.append(folded)
    return "".join(source), "".join(target)


def norm_text(c) -> Column:
    """Full-width forms and wide spaces to their plain form, in the JVM.

    Rows without such characters, nearly all, pay one scan. Rarer compatibility characters and
    combining sequences are the job of ``python_text.nfkc``, to be applied once at ingest.
    """
    text = _text(c)
    return F.when(
        text.rlike("[\u00a0\u3000\uff01-\uffee]"), F.translate(text, *_width_table())
    ).otherwise(text)


def squeeze(c) -> Column:
    """Trim and collapse every run of white space to one space."""
    return F.trim(F.regexp_replace(_text(c), SPACES, " "))


def note_text(title, desc) -> Column:
    """Title and body on one line, without the title when the body repeats it."""
    t, d = squeeze(title), squeeze(desc)
    return F.when((t != "") & d.startswith(t), d).otherwise(F.trim(F.concat(t, F.lit(" "), d)))


def clean_tags(c) -> Column:
    return squeeze(F.regexp_replace(_text(c), TAG_MARK, " "))


def strip_hashtags(c) -> Column:
    return F.regexp_replace(_text(c), TOPIC_TAG, " ")


def only(c: Column, outside: str) -> Column:
    """Drop every run matching ``outside``; splitting and joining beats replacing match by match."""
    return F.array_join(F.split(c, outside), "")


def norm_for_hash(c) -> Column:
    return only(F.lower(norm_text(c)), NO_WORD_OR_CJK)


def substance(c) -> Column:
    """Length of what is left once links, tags, handles and punctuation are gone; a CJK
    character counts twice."""
    s = _text(c)
    for pattern in (URL, HASHTAG, HANDLE, EMOJI_TAG):
        s = F.regexp_replace(s, pattern, " ")
    prose = once(s, lambda x: only(norm_text(x), NO_WORD_OR_CJK_ANY_CASE))
    return once(prose, lambda x: F.length(x) + F.regexp_count(x, F.lit(CJK)))


# fixed values: the opening of a long text, and more than what signs cut off at its end can add to its substance. A cut leaves
# standing at most what begins a link (8 characters), a tag (46), a handle (21) and an emoji code (14), each worth 2 at most.
OPENING = 1_000
CUT_SIGNS = 200


def substance_up_to(c, most: int) -> Column:
    """``substance`` where it is below ``most``, else ``most`` or more: of a long text its opening mostly tells."""
    text = _text(c)
    opening = once(F.when(F.length(text) > OPENING, substance(F.substring(text, 1, OPENING))), lambda n: F.when(n >= most + CUT_SIGNS, n - CUT_SIGNS))
    return F.coalesce(opening, substance(text))


def is_bot_prompt(c, handles=K.BOT_HANDLES) -> Column:
    hit = F.lit(False)
    for handle in handles:
        hit = hit | _text(c).contains("@" + handle)
    return hit


def mask_phrases(c, phrases: Column) -> Column:
    """Overwrite each phrase with a filler of the same length, so positions keep their meaning."""
    return F.aggregate(
        phrases, _text(c),
        lambda acc, p: F.replace(acc, p, F.repeat(F.lit("\x00"), F.length(p))),
    )


def is_latin_term(term) -> Column:
    return F.lower(_text(term)).rlike(LATIN_TERM)


def bounded_pattern(term) -> Column:
    """Pattern for a Latin term that must not touch another letter or digit. It begins with the term itself, which is sought
    quickly; what stands before is looked at from behind the term."""
    t = F.lower(_text(term))
    return F.concat(F.lit(r"\Q"), t, F.lit(r"\E(?<![0-9a-z]\Q"), t, F.lit(r"\E)(?![0-9a-z])"))


def has_term(lower_text, term) -> Column:
    """Does an already normalised lower-case text contain the term, by its boundary rule?"""
    t = F.lower(_text(term))
    text = _text(lower_text)
    return F.when(t == "", F.lit(False)).otherwise(
        F.contains(text, t) & (~is_latin_term(term) | F.rlike(text, bounded_pattern(term)))
    )


def term_position(text, term) -> Column:
    """0-based position of the first mention, -1 when absent."""
    return position_in(F.lower(norm_text(text)), term)


def position_in(lower_text, term) -> Column:
    """``term_position`` in text that is already normalised and in lower case."""
    low, t = F.col(lower_text) if isinstance(lower_text, str) else lower_text, F.lower(_text(term))
    return F.when(t == "", F.lit(-1)).when(
        is_latin_term(term), F.regexp_instr(low, bounded_pattern(term)) - 1
    ).otherwise(F.instr(low, t) - 1)


def term_count(text, term) -> Column:
    """Number of non-overlapping mentions."""
    low, t = F.lower(norm_text(text)), F.lower(_text(term))
    plain = (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)
    return F.when(t == "", F.lit(0)).when(
        is_latin_term(term), F.regexp_count(low, bounded_pattern(term))
    ).otherwise(plain.cast("int"))


def at_most_once(lower_text, term) -> Column:
    """Is the term mentioned at most ASIDE_MAX_HITS times in normalised lower-case text?"""
    low, t = _text(lower_text), F.lower(_text(term))
    plain = (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)
    return F.when(t == "", F.lit(True)).when(plain <= K.ASIDE_MAX_HITS, F.lit(True)).when(
        is_latin_term(term), F.regexp_count(low, bounded_pattern(term)) <= K.ASIDE_MAX_HITS
    ).otherwise(F.lit(False))


def excerpt(text, pos, width: int = K.NOTE_TRUNC) -> Column:
    """A window of the text around the position, keeping the opening."""
    s = _text(text)
    p = F.col(pos) if isinstance(pos, str) else pos
    body_len = width - K.HEAD_KEEP
    start = F.greatest(F.lit(K.HEAD_KEEP), p - width // 4)
    window = F.rtrim(F.concat(
        F.rtrim(F.substring(s, 1, K.HEAD_KEEP)), F.lit("…"),
        F.substring(s, start + 1, F.lit(body_len)),
    ))
    tail = F.when(start + body_len < F.length(s), F.lit("…")).otherwise(F.lit(""))
    return F.when((p < 0) | (p + K.MENTION_TAIL <= width), F.substring(s, 1, width)).otherwise(
        F.concat(window, tail)
    )


def is_aside(text, hits) -> Column:
    h = F.col(hits) if isinstance(hits, str) else hits
    return (h <= K.ASIDE_MAX_HITS) & (F.length(_text(text)) >= K.ASIDE_MIN_LEN)


def hamming64(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b))


def sha256_hex(c) -> Column:
    return F.sha2(_text(c), 256)


def search_match(c, query: str) -> Column:
    """Case-insensitive for ASCII letters only; ``%`` and ``_`` in the query are wildcards, a backslash is
    itself."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = query.translate(str.maketrans(upper, upper.lower())).replace("\\", "\\\\")
    return F.translate(_text(c), upper, upper.lower()).like("%" + folded + "%")
