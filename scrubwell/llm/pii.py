"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained in numpy on a small labelled table and decoded by Viterbi, many texts at
once. Neighbouring words of one label are parted into spans that pass a check of their kind and
touch no pattern's span.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import per_batch
from .words import Words, words

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)

#: the labelled table: one text a line, word/label; a word without label is O
LABELLED = """
write to ann.lee@mail.org/email today
mail bob_77@site.example.com/email, or call
contact: x.y-z@host.co.uk/email.
the address <jo@corp.net>/email is old
reply to kim99@localhost/email please
the server 10.0.0.1/ip answered
from 192.168.17.254/ip, and then
host 8.8.4.4/ip: no reply
ping 172.16.0.12/ip failed twice
card 4111/card 1111/card 1111/card 1111/card expired
paid with 5500-0000-0000-0004/card today
number 4111111111111111/card was used
the card 371449635398431/card, she said
old card 6011/card 0009/card 9013/card 9424/card in mail
call (456)/phone 555-2186/phone now
phone +1/phone (456)/phone 555-2186/phone or mail
ring 456-555-2186/phone after nine
tel. 0171/phone 555/phone 2186/phone please
at +49/phone 30/phone 5552186/phone, thanks
dial 4565552186/phone soon
number (020)/phone 7946/phone 0958/phone today
the password=hunter22x9/secret was lost
and password=ab12cd34ef56/secret here
set token=9f8e7d6c5b4a3f2e/secret now
with api_key=Zx81kq09Lm22/secret in it
secret:q8w7e6r5t4y3/secret is old
key: sk-9a8b7c6d5e4f3a2b/secret is mine
mail kim99@localhost/email bob@mailhost/email today
write to ann@intranet/email, lee_4@localhost/email please
from kim@localhost/email bob@localhost/email and others
both password=hunter22x9/secret token=9f8e7d6c5b4a3f2e/secret leaked
with api_key=Zx81kq09Lm22/secret, secret=ab12cd34ef56/secret in it
the key: sk-9a8b7c6d5e4f3a2b/secret token: Zx81kq09Lm22/secret is old
in 1999 and 2021 they met
on 2021-05-06 it rained
in 1999 2021-05-06 and 2001
from 12 1990 to 2005 yes
at 10:30 or 23:59 we leave
a price of 12.50 and 1,200
version 3.2.1 and 2.0
chapter 12 verse 4 line 345
page 12/345 of 900
the ratio 3:1 is fine
it has 4567 rows and 12345678 words
set x=5 and y=12 there
the word=word pair is plain
see note: this is fine
a 50% cut and +3 more
| 45 | 67 | 89 |
rooms 101 102 103 and 104
the 2nd and 3rd of 21st
b2b and h2o and mp3 files
fun### and very*** of%%% words&&&
THE!! BIG!! ONE!! SHOUTS!!
It was a long and plain text, of words.
And (so they say) the end. It is.
one-two three-four well-known
u.s. and e.g. or i.e. here
http://www.site.org/en/page is a link
"""

# a shape is a number in a mixed base; each digit is one feature of the word
_PARTS = (("digits", 7), ("at", 2), ("dots", 3), ("begin", 5), ("dash", 2), ("equals", 3), ("letters", 2))
SHAPES = int(np.prod([n for _, n in _PARTS]))
_DIGIT_STEPS = np.array([1, 4, 5, 9, 12, 20])


def _shape_features() -> np.ndarray:
    """[shape, feature] indicator matrix: every part's value, and the shape itself."""
    columns, step = [], 1
    shape = np.arange(SHAPES)
    for _, n in _PARTS:
        columns.append(np.eye(n)[shape // step % n])
        step *= n
    return np.concatenate(columns, 1)


def shapes(part: Words) -> np.ndarray:
    """The shape of every word, from counts of byte classes."""
    if not len(part.starts):
        return np.zeros(0, np.int64)
    data = part.data
    edges = np.stack([part.starts, part.ends], 1).ravel()
    edges = edges[:-1] if edges[-1] == len(data) else edges

    def count(mask):
        return np.add.reduceat(mask.astype(np.int32), edges)[::2]

    digit = (data >= 48) & (data <= 57)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    first = data[part.starts]
    begin = np.select([digit[part.starts], first == 43, first == 40, letter[part.starts]], [1, 2, 3, 0], 4)
    equals, colon = count(data == 61), count(data == 58)
    values = {"digits": np.searchsorted(_DIGIT_STEPS, count(digit), "right"), "at": np.minimum(count(data == 64), 1),
              "dots": np.searchsorted([1, 3], count(data == 46), "right"), "begin": begin, "dash": np.minimum(count(data == 45), 1),
              "equals": np.where(equals > 0, 2, np.where(colon > 0, 1, 0)), "letters": np.minimum(count(letter), 1)}
    out, step = np.zeros(len(part.starts), np.int64), 1
    for name, n in _PARTS:
        out += values[name] * step
        step *= n
    return out


#: a word is only left undecoded if O leads by more than rounding can change
_MARGIN = 1e-2


def _ends(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every text that has words."""
    some = np.diff(offsets) > 0
    return offsets[:-1][some], offsets[1:][some] - 1


class Field:
    """Label scores of a shape here, before and after; scores of neighbouring labels."""

    def __init__(self, here, before, after, pairs):
        self.here, self.before, self.after, self.pairs = here, before, after, pairs

    def scores(self, shape: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[label, word]: how far a label is above O at a word, by its own shape and its neighbours'."""
        here, before, after = ((x - x[:, :1]).T for x in (self.here, self.before, self.after))
        first, last = _ends(offsets)
        out = here[:, shape]
        side = before[:, shape[:-1]]
        side[:, first[1:] - 1] = 0
        out[:, 1:] += side
        side = after[:, shape[1:]]
        side[:, last[:-1]] = 0
        out[:, :-1] += side
        return out

    def undecided(self, score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The words that need decoding; for all others a bound proves that the best sequence says O.

        A label's lead over O from the left is at most its score plus the most that its link to any
        label before is above O's link to the same label; or, following O back one more word, the most
        over the labels before of their own lead plus the link, less the link from O to O. The same holds
        from the right. Where both leads together are below zero for every label, O is best."""
        pairs, k = self.pairs, len(self.pairs)
        left, right = (pairs - pairs[:, :1]).max(0), (pairs - pairs[:1]).max(1)
        first, last = _ends(offsets)
        begun, ended = score + left[:, None], score + right[:, None]
        begun[:, first], ended[:, last] = score[:, first], score[:, last]
        open_ = np.zeros(score.shape[1], bool)
        for label in range(1, k):
            lead = np.full(score.shape[1], left[label])
            lead[1:] = np.minimum(lead[1:], (begun[:, :-1] + pairs[:, label, None]).max(0) - pairs[0, 0])
            lead[first] = 0
            open_side = np.full(score.shape[1], right[label])
            open_side[:-1] = np.minimum(open_side[:-1], (ended[:, 1:] + pairs[label][:, None]).max(0) - pairs[0, 0])
            open_side[last] = 0
            open_ |= score[label] + lead + open_side > -_MARGIN
        return np.flatnonzero(open_)

    def labels(self, shape: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words whose best label is not O, and these labels, for whole texts: Viterbi over the runs
        of undecided words, between words that are O."""
        if not len(shape):
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        score = self.scores(shape, offsets)
        at = self.undecided(score, offsets)
        if not len(at):
            return at, np.zeros(0, np.uint8)
        first, last = _ends(offsets)
        begins, ends = np.isin(at, first), np.isin(at, last)
        new = np.concatenate(([True], np.diff(at) > 1)) | begins
        runs = np.append(np.flatnonzero(new), len(at))
        score = score[:, at].T.copy()
        score[new & ~begins] += self.pairs[0]
        score[np.append(new[1:], True) & ~ends] += self.pairs[:, 0]
        found = self.decode(score, runs)
        return at[found > 0], found[found > 0]

    def decode(self, score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label sequence of every run; all runs advance together."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        start, sizes = offsets[:-1][order], lengths[order]
        back = np.zeros(score.shape, np.uint8)
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), "left")
        labels, best = np.zeros(len(score), np.uint8), np.zeros((len(sizes), score.shape[1]), score.dtype)
        for t in range(len(live) - 1):
            at = start[:live[t]] + t
            if t == 0:
                best[:live[0]] = score[at]
                continue
            step = best[:live[t], :, None] + self.pairs
            back[at] = step.argmax(1)
            best[:live[t]] = step.max(1) + score[at]
        label = best.argmax(1)
        for t in range(len(live) - 2, -1, -1):
            at = start[:live[t]] + t
            labels[at] = label[:live[t]]
            label[:live[t]] = back[at, label[:live[t]]]
        return labels


def train(table: str = LABELLED, *, rounds: int = 400, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by forward-backward over the labelled table."""
    rows = [[w.rsplit("/", 1) if "/" in w and w.rsplit("/", 1)[-1].rstrip(",.:") in KINDS else [w, "O"] for w in line.split()]
            for line in table.strip().split("\n")]
    texts = [" ".join(w + label[len(label.rstrip(",.:")):] for w, label in row) for row in rows]
    gold = np.concatenate([[LABELS.index(label.rstrip(",.:")) for _, label in row] for row in rows])
    (part,) = words(pa.array(texts), 1 << 30)
    shape, offsets = shapes(part), part.offsets
    n, length, k = len(texts), int(np.diff(offsets).max()), len(LABELS)
    features = _shape_features()
    f = features.shape[1]
    place = np.repeat(np.arange(n), np.diff(offsets)), np.arange(len(shape)) - np.repeat(offsets[:-1], np.diff(offsets))
    x = np.zeros((n, length, 3 * f))
    x[place[0], place[1], :f] = features[shape]
    x[:, 1:, f:2 * f] = x[:, :-1, :f]
    x[:, :-1, 2 * f:] = x[:, 1:, :f]
    mask = np.zeros((n, length), bool)
    mask[place] = True
    x *= mask[:, :, None]
    truth = np.zeros((n, length, k))
    truth[place[0], place[1], gold] = 1
    true_pairs = np.einsum("ntk,ntl->kl", truth[:, :-1] * mask[:, 1:, None], truth[:, 1:])
    weights, pairs = np.zeros((3 * f, k)), np.zeros((k, k))
    squares, pair_squares = np.full_like(weights, 1e-3), np.full_like(pairs, 1e-3)
    log_sum = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    for _ in range(rounds):
        score = x @ weights
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            step = log_sum(forward[:, t - 1, :, None] + pairs, 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = log_sum(pairs + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, backward[:, t + 1])
        total = log_sum(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(forward[:, :-1, :, None] + pairs + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grad = np.einsum("ntf,ntk->fk", x, truth - single) - decay * len(shape) * weights
        grad_pairs = true_pairs - joint.sum((0, 1)) - decay * len(shape) * pairs
        squares += grad ** 2
        pair_squares += grad_pairs ** 2
        weights += rate * grad / np.sqrt(squares)
        pairs += rate * grad_pairs / np.sqrt(pair_squares)
    tables = [(features @ weights[i * f:(i + 1) * f]).astype(np.float32) for i in range(3)]
    return Field(*tables, pairs.astype(np.float32))


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a match can only begin at the first digit of a run, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, by kind and start. Every pattern takes time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def _plausible(kind: str, found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        return re.fullmatch(r"[^@\s]+@[^@\s]+", found) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "secret":
        # words that end in = or : may stand before a value; a key after it begins another secret
        parts = found.split()
        value = next((i for i, w in enumerate(parts) if w[-1] not in "=:"), len(parts))
        if any("=" in w or ":" in w for w in parts[value + 1:]):
            return False
        value = re.split(r"[=:]", found)[-1]
        return len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return False  # an address that the pattern does not take is none


#: most words and digits of one span
_WORDS = {"email": 1, "card": 19, "phone": 15, "secret": 15}
_DIGITS = {"card": 19, "phone": 15}


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without punctuation at its ends."""
    span = text[start:end].lstrip("<\"'[{")
    start = end - len(span)
    return start, start + len(span.rstrip(".,;:!?>\"']}"))


def parted(text: str, kind: str, at: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The plausible spans over neighbouring words (their starts and ends) that leave out the fewest
    words; of these the most spans. No span goes on after a word that ends in a comma or semicolon."""
    best, last = [(0, 0)] + [(-1, 0)] * len(at), [None] * (len(at) + 1)
    for i, (first, _) in enumerate(at):
        if best[i] > best[i + 1]:
            best[i + 1], last[i + 1] = best[i], None
        digits = 0
        for j in range(i, min(len(at), i + _WORDS.get(kind, 0))):
            digits += len(_NOT_DIGIT.sub("", text[slice(*at[j])]))
            if digits > _DIGITS.get(kind, digits):
                break
            start, end = _bare(text, first, at[j][1])
            covered = best[i][0] + j + 1 - i, best[i][1] + 1
            if start < end and covered > best[j + 1] and _plausible(kind, text[start:end]):
                best[j + 1], last[j + 1] = covered, (i, start, end)
            if text[at[j][1] - 1] in ",;":
                break
    out, i = [], len(at)
    while i:
        if last[i]:
            out.append((kind, *last[i][1:]))
        i = last[i][0] if last[i] else i - 1
    return out[::-1]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


class Finder:
    def __init__(self, field: Field):
        self.field = field
        # every match of a fixed pattern holds a digit or an @
        value = dict(zip((name for name, _ in _PARTS), np.unravel_index(np.arange(SHAPES), [n for _, n in _PARTS], order="F")))
        self.telling = (value["digits"] > 0) | (value["at"] > 0)

    def run(self, batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digest, joined = np.zeros((4, n), np.int64), [empty] * n, [""] * n
            for part in words(batch.column(1)):
                shape = shapes(part)
                found, label = self.field.labels(shape, part.offsets)
                text_of = np.searchsorted(part.offsets, found, "right") - 1
                take = np.union1d(text_of, np.searchsorted(part.offsets, np.flatnonzero(self.telling[shape]), "right") - 1)
                cuts = np.searchsorted(text_of, np.append(take, len(part.offsets)))
                column = batch.column(1).take(pa.array(take + part.first)).to_pylist()
                for k, (i, text) in enumerate(zip(take, column)):
                    text = text or ""
                    base = base_spans(text)
                    marked = slice(cuts[k], cuts[k + 1])
                    extra = self.added(text, part, part.text_at[i], found[marked], label[marked], base) if cuts[k] < cuts[k + 1] else []
                    row = part.first + i
                    for j in range(4):
                        counts[j, row] = sum(s[0] == KINDS[j] for s in base)
                    digest[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    joined[row] = _joined(sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(joined)],
                                             names=["row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    def added(self, text, part, text_start, found, labels, base):
        """Spans over runs of one label, in code points. A word that touches a pattern's span parts a run."""
        raw, at, chars, where = text.encode("utf-8", "surrogatepass"), 0, 0, []
        for word in found:
            a, b = int(part.starts[word] - text_start), int(part.ends[word] - text_start)
            start = chars + len(raw[at:a].decode("utf-8", "surrogatepass"))
            at, chars = b, start + len(raw[a:b].decode("utf-8", "surrogatepass"))
            where.append((start, chars))
        base = sorted((s, e) for _, s, e in base)
        starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))

        def free(start, end):
            before = bisect_left(starts, end)
            return not before or ends[before - 1] <= start

        out, run = [], []
        for j, (word, label) in enumerate(zip(found, labels)):
            if run and (word != found[j - 1] + 1 or label != labels[j - 1]):
                out += parted(text, LABELS[labels[j - 1]], run)
                run = []
            if free(*_bare(text, *where[j])):
                run.append(where[j])
            elif run:
                out += parted(text, LABELS[label], run)
                run = []
        return out + (parted(text, LABELS[labels[-1]], run) if run else [])


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    The counts and the digest are those of the fixed patterns; ``spans`` lists these and the
    field's as kind:start:end (code points, end exclusive), by kind, then start. Null texts are
    empty and have no spans; repeated rows are treated alike; an empty table gives no rows; other
    columns are ignored. The field labels all words of a text by its best sequence; words that a
    bound proves to be O need no decoding.
    A run of words of one kind may hold several spans, of at most 19 words (phones and secrets 15,
    e-mails one).
    """
    finder = Finder(field or train())
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_batch(finder.run), f"row struct<id:{kind}>, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
                           ).select(F.col("row.id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
