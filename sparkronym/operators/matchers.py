"""Rules that find acronyms and what they stand for in one text: text -> {acronym: expansion or None}.

Each rule is a plain function; extract.py runs them over tables. A null expansion means
that the acronym was seen without one.
"""

from __future__ import annotations

import re

#: What digits stand for inside of an acronym.
DIGIT_NAMES = {
    "0": ("zero",), "1": ("one", "first", "i"), "2": ("two", "second", "ii"), "3": ("three", "third", "iii"), "4": ("four", "fourth", "iv"),
    "5": ("five", "fifth", "v"), "6": ("six", "sixth", "vi"), "7": ("seven", "seventh", "vii"), "8": ("eight", "eighth", "viii"), "9": ("nine", "ninth", "ix"),
}
#: Words that are no acronyms and begin no expansion.
FUNCTION_WORDS = frozenset("a an and are as at be by for from in into is it of on or that the their this to was were which with".split())
ROMAN = frozenset("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split())
Pairs = dict[str, "str | None"]


def alnum(s: str) -> int:
    return sum(c.isalnum() for c in s)


# -- pairs in brackets, the shorter from right to left in the longer ----------------------------


def match_right_to_left(short: str, long: str) -> str | None:
    """The shortest end of long, from a word's start, that holds the letters of short in order."""
    at = len(long)
    letters = [c.lower() for c in short if c.isalnum()]
    if not letters:
        return None
    for k in range(len(letters) - 1, -1, -1):
        at -= 1
        while at >= 0 and (long[at].lower() != letters[k] or k == 0 and at > 0 and long[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
    return long[long.rfind(" ", 0, at + 1) + 1 :]


def plausible(short: str, best: str | None) -> bool:
    if best is None or len(short) < 2:
        return False
    n, words = alnum(short), len(re.split(r"[ -]", best))
    return len(best) >= len(short) and f"{short} " not in best and not best.endswith(short) and words <= min(2 * n, n + 5) and n <= 10


def is_short(s: str) -> bool:
    return any(c.isalpha() for c in s) and (s[0].isalnum() or s[0] == "(")


def schwartz_hearst(text: str) -> Pairs:
    """Line by line: `long (short)`, or `short (long)` where the bracket holds more than two words or the longer text."""
    found: Pairs = {}
    buffer, fresh = "", True
    for line in text.split("\n"):
        if not line.strip() or fresh and not line[0].isupper():
            buffer, fresh = "", True
            continue
        fresh = False
        buffer += line + " "
        buffer = _brackets(buffer, found)
    return found


def _last_break(s: str) -> int:
    return max(s.rfind(". ") + 2 if ". " in s else 0, s.rfind(", ") + 2 if ", " in s else 0)


def _brackets(buffer: str, found: Pairs) -> str:
    """Takes the closed brackets of the buffer; what is left waits for the next line."""
    while True:
        at = buffer.find(" (")
        if at < 0:
            return buffer[_last_break(buffer) :]
        end = buffer.find(")", at)
        if end < 0:  # the bracket goes on in the next line, within reason
            return buffer if len(buffer) - at <= 200 else buffer[at + 2 :]
        inner = buffer[at + 2 : end]
        if "(" in inner:
            nxt = buffer.find(")", end + 1)
            if nxt > 0:
                inner, end = buffer[at + 2 : nxt], nxt
        before = buffer[:at]
        long, short = before[_last_break(before) :], inner
        for mark in (", ", "; "):
            if mark in short:
                short = short[: short.index(mark)]
        if len(short.split()) > 2 or len(short) > len(long):
            word = before.split(" ")[-1] if before else ""
            short, long = (word, short) if any(c.isupper() for c in word) else ("", "")
        if short and is_short(short):
            best = match_right_to_left(short, long)
            if plausible(short, best):
                found[short] = best
        buffer = buffer[end + 1 :]


DASHES = re.compile(r"[\s‐-―-]+")


def candidates(text: str) -> list[str]:
    """Tokens that look like acronyms."""
    out = []
    for t in DASHES.split(text):
        t = t.strip("()[]{},;:.!?\"'")
        if len(t) >= 2 and not t[1:].islower() and not re.fullmatch(r"[A-Z]\.", t) and any(c.isupper() for c in t) and t[0].isalnum():
            out.append(t)
    return out


def with_seen(rule, seen=candidates):
    """The rule's pairs, with the acronyms that it leaves out as null."""

    def run(text: str) -> Pairs:
        return {a: None for a in seen(text)} | rule(text)

    return run


# -- boundaries `(`, `:` and `-`; letters from either side; digits as words ------------------------


def _trim(s: str) -> str:
    """Without marks at both ends, but with brackets that close inside."""
    a, b = 0, len(s)
    while a < b and not s[a].isalnum() and not (s[a] in "([{" and ")]}"["([{".index(s[a])] in s[a + 1 : b]):
        a += 1
    while b > a and not s[b - 1].isalnum() and not (s[b - 1] in ")]}" and "([{"[")]}".index(s[b - 1])] in s[a : b - 1]):
        b -= 1
    return s[a:b]


def acceptable(a: str, english: frozenset[str] = frozenset()) -> bool:
    words = a.split()
    if len(a) < 2 or not words or len(words) > 2 or alnum(a) > 10 or not any(c.isalpha() for c in a) or a.lower() in FUNCTION_WORDS:
        return False
    return not a[1:].islower() or bool(english) and any(w.lower() not in english for w in words)


def align(short: str, words: list[str], at_end: bool) -> str | None:
    """The run of words next to the acronym that holds its letters in order.

    at_end: the acronym stands to the right; letters are then sought from right to left,
    else from left to right. The first met must be in the word next to the acronym, the
    acronym's first letter begins a word, and a digit is a whole word, itself or one of
    its names. The run is of whole words, min(n + 5, 2n) at most."""
    letters = [c.lower() for c in short if c.isalnum()]
    if not letters:
        return None
    step = -1 if at_end else 1
    order = range(len(words) - 1, -1, -1) if at_end else range(len(words))
    k = len(letters) - 1 if at_end else 0
    for count, i in enumerate(order):
        w = words[i].lower()
        bare = w.strip(".,;:")
        at, met = (len(w) if at_end else 0), False
        while 0 <= k < len(letters):
            if letters[k].isdigit():
                if not met and (bare == letters[k] or bare in DIGIT_NAMES[letters[k]]):
                    met, k = True, k + step
                break
            if k == 0:
                here = 0 if w[:1] == letters[0] and (at > 0 if at_end else at == 0) else -1
            else:
                here = w.rfind(letters[k], 0, at) if at_end else w.find(letters[k], at)
            if here < 0:
                break
            at, met, k = (here if at_end else here + 1), True, k + step
        if count == 0 and not met:
            return None
        if not 0 <= k < len(letters):
            n = count + 1
            if n > min(len(letters) + 5, 2 * len(letters)):
                return None
            return " ".join(words[i:] if at_end else words[: i + 1])
    return None


def boundaries(text: str, english: frozenset[str] = frozenset(), marks: str = "(:-") -> Pairs:
    """Per line, at each boundary mark, the acronym on one side and its expansion on the other."""
    found: Pairs = {}
    for line in text.split("\n"):
        for at, mark in enumerate(line):
            if mark not in marks:
                continue
            if mark == "(":
                end = line.find(")", at)
                if end < 0:
                    continue
                short = _trim(line[at + 1 : end])
                long = _trim(re.split(r"[:;!?.] ", line[:at])[-1])
                at_end = True
            else:
                left, right = line[at - 1 : at].isspace(), line[at + 1 : at + 2].isspace()
                if at < 2 or not (left and right if mark == "-" else left or right):
                    continue
                before = line[:at].split()
                short = _trim(before[-1]) if before else ""
                long = _trim(re.split(r"[:;!?.](?:\s|$)", line[at + 1 :])[0])
                at_end = False
            if len(short) > len(long) or len(short.split()) > 2:
                other = long.split()
                short, long, at_end = (other[-1] if at_end and other else other[0] if other else ""), short, not at_end
            words = long.split()
            if not acceptable(short, english) or {w.lower() for w in short.split()} <= {w.lower() for w in words}:
                continue
            best = align(short, words, at_end)
            if best is not None and short.lower() not in best.lower().split():
                found[short] = best
    return found


def brackets_only(text: str) -> Pairs:
    """The older form of boundaries: brackets alone, and no dictionary of English."""
    return boundaries(text, marks="(")


# -- tokens ----------------------------------------------------------------------------------------


TOKEN = re.compile(r"\w+(?:[-'./]\w+)*|[^\w\s]")


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text)


def upper_share(t: str) -> float:
    return sum(c.isupper() for c in t) / max(1, len(t))


def match_left_to_right(short: str, long: str) -> str | None:
    """The shortest beginning of long, to a word's end, that holds the letters of short in order, the first at its start."""
    letters = [c.lower() for c in short if c.isalnum()]
    at = 0
    for k, c in enumerate(letters):
        found = long.lower().find(c, at)
        if found < 0 or not k and found:
            return None
        at = found + 1
    return long[: (long + " ").index(" ", at)] if letters else None


def tag_characters(tokens: list[str]) -> list[str]:
    """BIO tags of `long ( ABC )` and `ABC ( long )`: the letters of ABC in order in the words next to the bracket,
    sought from the bracket's side on, min(n + 5, 2n) words at most."""
    tags = ["O"] * len(tokens)
    for i, t in enumerate(tokens):
        if not (2 <= len(t) <= 10 and t[0].isupper() and upper_share(t) > 0.6):
            continue
        most = min(len(t) + 5, 2 * len(t))
        tags[i] = "B-short"
        span: range = range(0)
        if i + 1 < len(tokens) and tokens[i + 1] == "(":
            end = next((k for k in range(i + 2, len(tokens)) if tokens[k] == ")"), len(tokens))
            best = match_left_to_right(t, " ".join(tokens[i + 2 : min(end, i + 2 + most)]))
            span = range(i + 2, i + 2 + len(best.split())) if best else span
        elif i > 1 and tokens[i - 1] == "(":
            best = match_right_to_left(t, " ".join(tokens[max(0, i - 1 - most) : i - 1]))
            span = range(i - 1 - len(best.split()), i - 1) if best else span
        for k in span:
            tags[k] = "B-long" if k == span[0] else "I-long"
    return tags


def chunks(tokens: list[str], tags: list[str]) -> list[tuple[str, int, int]]:
    """(kind, from, to) of tagged runs; a B, or a change of kind, begins one."""
    out: list[tuple[str, int, int]] = []
    for i, tag in enumerate(tags):
        if tag == "O" or "-" not in tag:
            continue
        head, kind = tag.split("-", 1)
        if head == "B" or not out or out[-1][2] != i or out[-1][0] != kind:
            out.append((kind, i, i + 1))
        else:
            out[-1] = (kind, out[-1][1], i + 1)
    return out


def pairs_from_tags(tokens: list[str], tags: list[str]) -> Pairs:
    """Each long form with the first short form that fits it: by all its capitals, by the initials, by most of
    the initials, by brackets between the two, or by nearness; the first of these that holds."""
    parts = chunks(tokens, tags)
    shorts = [p for p in parts if p[0] == "short"]
    found: Pairs = {" ".join(tokens[a:b]): None for _, a, b in shorts}
    text = lambda p: " ".join(tokens[p[1] : p[2]])

    def capitals(s, p):
        return [c for c in text(s) if c.isupper()] == [c for w in tokens[p[1] : p[2]] for c in w if c.isupper()]

    def initials(s, p):
        return [c.lower() for c in text(s) if c.isupper()] == [w[0].lower() for w in tokens[p[1] : p[2]]]

    def most(s, p):
        heads = [w[0].lower() for w in tokens[p[1] : p[2]]]
        return sum(h in text(s).lower() for h in heads) >= 0.6 * len(heads)

    def bracket(s, p):
        first, second = (s, p) if s[1] < p[1] else (p, s)
        return tokens[first[2] : second[1]] == ["("]

    def near(s, p):
        return max(p[1] - s[2], s[1] - p[2]) < 3

    for p in (x for x in parts if x[0] == "long"):
        for fits in (capitals, initials, bracket, most, near):
            s = next((s for s in shorts if found[text(s)] is None and fits(s, p)), None)
            if s is not None:
                found[text(s)] = text(p)
                break
    return found


def character_match(text: str) -> Pairs:
    tokens = words_of(text)
    return pairs_from_tags(tokens, tag_characters(tokens))


# -- a cascade of rules ------------------------------------------------------------------------------


def is_cascade_short(t: str) -> bool:
    t = t.replace(".", "")
    return 2 <= len(t) <= 10 and any(c.isalpha() for c in t) and upper_share(t) > 0.6


def _sides(tokens: list[str], i: int) -> list[tuple[list[str], bool]]:
    """Tokens next to a short form and whether they stand to its left: `S ( ... )` and `... ( S )`."""
    n = alnum(tokens[i])
    most, out = min(n + 5, 2 * n), []
    if i + 1 < len(tokens) and tokens[i + 1] == "(":
        end = tokens.index(")", i) if ")" in tokens[i:] else len(tokens)
        out.append((tokens[i + 2 : min(end, i + 2 + most)], False))
    if i and tokens[i - 1] == "(":
        left, k = [], i - 2
        while k >= 0 and len(left) < most and tokens[k] not in "().;:":
            left.insert(0, tokens[k])
            k -= 1
        out.append((left, True))
    return out


def cascade(text: str) -> Pairs:
    """Rules from the loosest to the strictest; a later rule replaces an earlier one's expansion."""
    tokens = words_of(text)
    shorts = [i for i, t in enumerate(tokens) if is_cascade_short(t)]
    found: Pairs = {tokens[i]: None for i in shorts}

    def letters_in_order(i):
        for side, left in _sides(tokens, i):
            long = " ".join(side)
            best = match_right_to_left(tokens[i], long) if left else None
            if not left:  # from the left: the nearest run that begins with the first letter
                for k in range(len(side), 0, -1):
                    got = match_right_to_left(tokens[i], " ".join(side[:k]))
                    if got is not None and got.split() == side[:k]:
                        best = got
            if plausible(tokens[i], best) and best.split()[0].lower() not in FUNCTION_WORDS:
                return best
        return None

    def bounded(i):
        best = letters_in_order(i)
        if best is None:
            return None
        last = tokens[i][-1].lower()
        words = best.split()
        while len(words) > 1 and last not in words[-1].lower():
            words.pop()
        return " ".join(words)

    def characters(i):
        if not tokens[i].isupper():
            return None
        for side, left in _sides(tokens, i):
            n = len(tokens[i])
            run = side[-n:] if left else side[:n]
            if [w[0].lower() for w in run] == list(tokens[i].lower()):
                return " ".join(run)
        return None

    def capitals(i):
        for side, left in _sides(tokens, i):
            at = [k for k, w in enumerate(side) if w[0].isupper()]
            for a in range(len(at)):
                for b in range(a + 1, len(at) + 1):
                    if "".join(side[k][0] for k in at[a:b]) == tokens[i]:
                        return " ".join(side[at[a] : at[b - 1] + 1])
        return None

    def stands_for(i):
        heads = [c.lower() for c in tokens[i] if c.isupper()]
        if [t.lower() for t in tokens[i + 1 : i + 3]] != ["stands", "for"]:
            return None
        run = tokens[i + 3 : i + 3 + len(heads)]
        return " ".join(run) if [w[0].lower() for w in run] == heads else None

    for rule in (letters_in_order, bounded, characters, capitals, stands_for):
        for i in shorts:
            got = rule(i)
            if got:
                found[tokens[i]] = got
    # a short form inside of another's expansion that has none of its own stays without
    return {a: e for a, e in found.items() if a not in ROMAN}


# -- French --------------------------------------------------------------------------------------------

#: French words that an acronym may pass over.
FRENCH_FUNCTION_WORDS = frozenset("le la les l un une des de du d et en à au aux pour par sur dans".split())


def french(text: str) -> Pairs:
    """By initials, to the left, to the right and in brackets, passing over function words; the shortest wins.

    A leading digit repeats the next letter; a trailing digit is carried over."""
    tokens = [t for t in re.findall(r"\w+|[^\w\s]", text.replace("’", "'"))]
    found: Pairs = {}
    for i, t in enumerate(tokens):
        if not is_cascade_short(t):
            continue
        m = re.fullmatch(r"(\d?)(\D+?)(\d*)", t)
        if m is None:
            continue
        heads = (m[2][0] * int(m[1]) + m[2][1:] if m[1] else m[2]).lower()
        best = None
        for side, left in _sides(tokens, i) + [(tokens[max(0, i - 2 * len(heads) - 1) : i], True), (tokens[i + 1 : i + 2 + 2 * len(heads)], False)]:
            for a in range(len(side)):
                for b in range(a + 1, len(side) + 1):
                    run = side[a:b]
                    full = [w for w in run if w.lower() not in FRENCH_FUNCTION_WORDS and w[0].isalnum()]
                    if run[0] in full[:1] and run[-1] in full[-1:] and all(w.isalnum() or w == "'" for w in run) and "".join(w[0] for w in full).lower() == heads and len(full) > 1:
                        got = " ".join(run) + (f" {m[3]}" if m[3] else "")
                        best = got if best is None or len(got) < len(best) else best
        found[t] = best
    return found


def french_schwartz_hearst(text: str) -> Pairs:
    return schwartz_hearst(text.replace("’", "'"))


def composed(find_acronyms, find_expansion):
    """A rule from an acronym finder and a finder of one acronym's expansion."""

    def run(text: str) -> Pairs:
        return {a: find_expansion(a, text) for a in find_acronyms(text)}

    return run


RULES = {
    "schwartz_hearst_original": with_seen(schwartz_hearst),
    "schwartz_hearst": with_seen(schwartz_hearst),
    "schwartz_hearst_abbreviations": with_seen(schwartz_hearst, lambda t: [x for x in words_of(t) if x.upper() == x and any(c.isupper() for c in x) and len(x) > 1]),
    "boundaries": with_seen(boundaries, lambda t: [x for x in words_of(t) if x.upper() == x and any(c.isupper() for c in x) and len(x) > 1]),
    "brackets": with_seen(brackets_only, lambda t: [x for x in words_of(t) if x.upper() == x and any(c.isupper() for c in x) and len(x) > 1]),
    "character_match": character_match,
    "cascade": cascade,
    "french": french,
    "french_schwartz_hearst": french_schwartz_hearst,
}


def best_expansion(rule, acronym: str, text: str) -> str | None:
    """What the rule makes of a text followed by the acronym in brackets."""
    return rule(f"{text} ({acronym})").get(acronym)
