"""Main text of web pages: a bidirectional LSTM labels every block in the context of its page."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.blocks import Block, blocks_of
from dugout.llm.common import col
from dugout.sources.scratch import materialize

#: Sizes of the hashed tag-path and word vectors, of the other figures, and of the state in each direction.
PATH, WORDS, FIGURES, STATE = 512, 32, 8, 16
#: The fit takes so many pages, of longer ones two runs of so many blocks, of each block's text so many code points,
#: and goes over them until it has made so many steps.
FIT_PAGES, RUN, BLOCK_LENGTH, STEPS, BATCH = 400, 256, 12_000, 90, 32
#: Pages a worker labels side by side, by their number of blocks.
SIDE_BY_SIDE = 1 << 14

# Names by which page authors mark what is not the article, and the article itself.
BOILERPLATE = frozenset(
    "nav navbar navigation menu header masthead footer aside sidebar ad ads adsense advert advertisement banner promo sponsor"
    " sponsored form login signup newsletter subscribe search cookie cookies consent notice alert popup modal dialog comment"
    " comments reply replies respond disqus share social related recommended breadcrumb breadcrumbs pagination pager widget"
    " copyright legal toolbar contentinfo complementary".split()
)
ARTICLE = frozenset("article main content post entry story".split())
_SWAPS = {
    "nav": (("div", "menu"), ("div", "navbar"), ("header",), ("div", "header"), ("div", "breadcrumbs")),
    "footer": (("div", "footer"), ("div", "copyright"), ("div", "legal")),
    "ad": (("advert",), ("sidebar",), ("promo",), ("banner",), ("sponsored",)),
    "article": (("div", "content"), ("main",), ("div", "post"), ("section", "entry"), ("div", "story"), ("div", "main")),
}
_EXTRA = (
    ("aside",), ("div", "sidebar"), ("div", "widget"), ("form",), ("div", "newsletter"), ("div", "search"),
    ("div", "cookie", "notice"), ("div", "alert"), ("div", "popup"), ("div", "notice"), ("header",), ("div", "masthead"),
    ("section", "comments"), ("div", "comments", "comment"), ("ol", "replies", "li", "comment"), ("div", "related"),
    ("div", "share"), ("div", "advertisement"), ("div", "login", "form"),
)


def taught(path: tuple[str, ...]) -> float | None:
    """What the names on a path say: 0 boilerplate, 1 article, None neither."""
    if BOILERPLATE.intersection(path):
        return 0.0
    return 1.0 if ARTICLE.intersection(path) else None


@dataclass
class Run:
    """Consecutive blocks of a page, and the number of blocks before and behind them."""

    blocks: list[Block]
    before: int = 0
    behind: int = 0


def runs_of(page: list[Block], rng: np.random.Generator) -> list[Run]:
    """What the fit sees of a page: all blocks, or of a long page a random run around a random block of the article and
    one around a random block of boilerplate. None if no name on the page teaches anything."""
    labels = [taught(b.path) for b in page]
    places = [[i for i, label in enumerate(labels) if label == kind] for kind in (1.0, 0.0)]
    if not any(places):
        return []
    starts = {0}
    if len(page) > RUN:
        around = [some[rng.integers(len(some))] for some in places if some]
        starts = {int(np.clip(i - rng.integers(RUN), 0, len(page) - RUN)) for i in around}
    cut = lambda b: Block(b.path, b.text[:BLOCK_LENGTH], min(b.linked, BLOCK_LENGTH))
    return [Run([cut(b) for b in page[s : s + RUN]], s, max(0, len(page) - s - RUN)) for s in sorted(starts)]


def varied(page: list[Block], others: list[Block], rng: np.random.Generator) -> list[tuple[Block, float]]:
    """A labelled page for learning: names changed or left out, and now and then a further kind of boilerplate.

    Pages of one site look alike. Changing the containers' names, and dropping them, makes the model read words and
    neighbours as well; the extra parts take their text from blocks of other pages.
    """
    labelled = [(b, taught(b.path)) for b in page]
    swaps = {old: new[rng.integers(len(new))] for old, new in _SWAPS.items() if rng.random() < 0.5}
    blank = rng.random() < 0.15
    out: list[tuple[Block, float]] = []
    for block, label in labelled:
        path = tuple(n for name in block.path for n in swaps.get(name, (name,)))
        if blank:
            path = tuple("div" if n in BOILERPLATE or n in ARTICLE else n for n in path)
        if label is not None:
            out.append((Block(path, block.text, block.linked), label))
    for _ in range(int(rng.integers(0, 4))):
        if not others:
            break
        where = int(rng.integers(0, len(out) + 1))
        inside = where < len(out) and out[where][1] == 1.0 and rng.random() < 0.4
        base = out[where][0].path if inside else ("html", "body")
        name = _EXTRA[rng.integers(len(_EXTRA))]
        extra = []
        for _ in range(int(rng.integers(1, 5))):
            words = others[rng.integers(len(others))].text.split()
            first = int(rng.integers(0, len(words)))
            text = " ".join(words[first : first + int(rng.integers(2, 40))])
            inner = (("p",), ("div",), ("ul", "li"), ())[rng.integers(4)]
            extra.append((Block(base + name + inner, text, len(text) if inner == ("ul", "li") else 0), 0.0))
        out[where:where] = extra
    return out


class _Slots(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        value = self[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return value


class Vectors:
    """Tag-path and block vectors of pages; both hash names, so nothing has to be looked up."""

    def __init__(self):
        self.path_slots, self.word_slots = _Slots(PATH), _Slots(WORDS)

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(PATH, np.float32)
        out[[self.path_slots[n] for n in path] + [self.path_slots["/" + n] for n in path[-1:]]] = 1.0
        return out

    def block(self, block: Block, place: float) -> np.ndarray:
        words = block.text.split()
        counts = np.bincount([self.word_slots[w] for w in words], minlength=WORDS).astype(np.float32)
        marks = sum(map(block.text.count, ".,;:!?"))
        n = len(words)
        figures = (
            np.log1p(n) / 4, len(block.text) / n / 8, block.linked / max(1, len(block.text)), marks / n,
            place, 1.0 - place, float(block.text[-1] in ".!?…"), float("©" in block.text),
        )
        return np.concatenate([counts / np.sqrt((counts**2).sum()), np.array(figures, np.float32)])

    def page(self, blocks: list[Block], before: int = 0, behind: int = 0) -> np.ndarray:
        last = max(1, before + len(blocks) + behind - 1)
        return np.stack([self.block(b, (before + i) / last) for i, b in enumerate(blocks)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Recurrence:
    """One direction: gates = given + state @ weights, in the order input, forget, output, candidate."""

    @staticmethod
    def forward(given: np.ndarray, weights: np.ndarray, mask: np.ndarray, keep: bool):
        """given (steps, pages, 4 * STATE); mask (steps, pages, 1) is 0 behind a page's end."""
        steps, pages, _ = given.shape
        states, held = np.zeros((steps + 1, pages, STATE), np.float32), np.zeros((pages, STATE), np.float32)
        trail = []
        for t in range(steps):
            z = given[t] + states[t] @ weights
            gates, new = _sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            before = held
            held = (f * before + i * new) * mask[t]
            squashed = np.tanh(held)
            states[t + 1] = o * squashed * mask[t]
            if keep:
                trail.append((gates, new, before, squashed))
        return states, trail

    @staticmethod
    def backward(grad: np.ndarray, states: np.ndarray, trail: list, weights: np.ndarray, mask: np.ndarray):
        steps, pages, _ = grad.shape
        to_given = np.zeros((steps, pages, 4 * STATE), np.float32)
        to_weights, to_state, to_held = np.zeros_like(weights), np.zeros((pages, STATE), np.float32), 0.0
        for t in range(steps - 1, -1, -1):
            gates, new, before, squashed = trail[t]
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            of_state = (grad[t] + to_state) * mask[t]
            of_held = (of_state * o * (1 - squashed**2) + to_held) * mask[t]
            z = np.concatenate(
                [of_held * new * i * (1 - i), of_held * before * f * (1 - f), of_state * squashed * o * (1 - o), of_held * i * (1 - new**2)],
                axis=1,
            )
            to_given[t] = z
            to_weights += states[t].T @ z
            to_state = z @ weights.T
            to_held = of_held * f
        return to_given, to_weights


def _reverse(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's own steps backwards, what is behind its end left in place."""
    steps = np.arange(values.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return values[at, np.arange(values.shape[1])]


class Labeller:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.learned = False
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"out": draw(2 * STATE), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {
                f"path_{d}": draw(PATH, 4 * STATE) * 2, f"block_{d}": draw(WORDS + FIGURES, 4 * STATE),
                f"state_{d}": draw(STATE, 4 * STATE), f"gate_{d}": np.zeros(4 * STATE, np.float32),
            }
            self.w[f"gate_{d}"][STATE : 2 * STATE] = 1.0

    def _run(self, paths: np.ndarray, of: np.ndarray, blocks: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """paths: distinct path vectors; of (steps, pages): which one; blocks (steps, pages, ...)."""
        mask = (np.arange(of.shape[0])[:, None] < lengths)[:, :, None].astype(np.float32)
        runs = {}
        for d in "fb":
            given = (paths @ self.w[f"path_{d}"])[of] + blocks @ self.w[f"block_{d}"] + self.w[f"gate_{d}"]
            given = _reverse(given, lengths) if d == "b" else given
            runs[d] = Recurrence.forward(given, self.w[f"state_{d}"], mask, keep)
        both = np.concatenate([runs["f"][0][1:], _reverse(runs["b"][0][1:], lengths)], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"]), both, runs, mask

    @staticmethod
    def _stacked(pages: list[tuple[np.ndarray, np.ndarray]]):
        lengths = np.array([len(p) for p, _ in pages])
        of = np.zeros((lengths.max(), len(pages)), np.int64)
        blocks = np.zeros((lengths.max(), len(pages), WORDS + FIGURES), np.float32)
        for k, (paths, own) in enumerate(pages):
            of[: len(paths), k], blocks[: len(own), k] = paths, own
        return of, blocks, lengths

    def fit(self, pages: list[Run], seed: int = 5) -> "Labeller":
        """Learn from pages whose names tell article from boilerplate, varied anew in each round; Adam on log loss."""
        rng, vectors = np.random.default_rng(seed), Vectors()
        others = [b for p in pages for b in p.blocks]
        self.learned = any(taught(b.path) == 1.0 for b in others)
        m, v, turn = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        while pages and turn < STEPS:
            order = rng.permutation(len(pages))
            for first in range(0, len(order), BATCH):
                some = [(varied(pages[i].blocks, others, rng), pages[i]) for i in order[first : first + BATCH]]
                ends = [(run.before, run.behind) for p, run in some if p]
                some = [p for p, _ in some if p]
                turn += 1
                if not some:
                    continue
                known = {path: k for k, path in enumerate(dict.fromkeys(b.path for p in some for b, _ in p))}
                paths = np.stack([vectors.path(path) for path in known])
                of, blocks, lengths = self._stacked([
                    (np.array([known[b.path] for b, _ in p]), vectors.page([b for b, _ in p], *e)) for p, e in zip(some, ends)
                ])
                truth = np.zeros(of.shape, np.float32)
                for k, p in enumerate(some):
                    truth[: len(p), k] = [label for _, label in p]
                guess, both, runs, mask = self._run(paths, of, blocks, lengths, keep=True)
                slope = ((guess - truth) * mask[:, :, 0] / mask.sum())[:, :, None]
                grads = {"out": (both * slope).sum(axis=(0, 1)), "bias": slope.sum(keepdims=True).reshape(1)}
                back = slope * self.w["out"]
                for d, part in (("f", back[:, :, :STATE]), ("b", _reverse(back[:, :, STATE:], lengths))):
                    states, trail = runs[d]
                    given, grads[f"state_{d}"] = Recurrence.backward(part, states, trail, self.w[f"state_{d}"], mask)
                    given = _reverse(given, lengths) if d == "b" else given
                    flat = given.reshape(-1, 4 * STATE)
                    sums = np.zeros((len(paths), 4 * STATE), np.float32)
                    np.add.at(sums, of.ravel(), flat)
                    grads[f"path_{d}"], grads[f"gate_{d}"] = paths.T @ sums, flat.sum(axis=0)
                    grads[f"block_{d}"] = blocks.reshape(-1, WORDS + FIGURES).T @ flat
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - 0.01 * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
        """Share of belief, for every block of every page, that it is article; pages of like length run together.

        Pages with blocks need weights that were learned; random ones would give any text.
        """
        if not self.learned and any(pages):
            raise ValueError("nothing learned: no page the labeller was fitted on names an article")
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            group = order[-max(1, SIDE_BY_SIDE // longest) :]
            del order[-len(group) :]
            known = {path: k for k, path in enumerate(dict.fromkeys(b.path for i in group for b in pages[i]))}
            paths = np.stack([vectors.path(path) for path in known])
            stacked = self._stacked([(np.array([known[b.path] for b in pages[i]]), vectors.page(pages[i])) for i in group])
            belief = self._run(paths, *stacked)[0]
            for k, i in enumerate(group):
                out[i] = belief[: len(pages[i]), k]
        return out


def fit(pages: DataFrame, *, html: str = "html") -> Labeller:
    """A labeller learned, in one task, from FIT_PAGES pages whose names teach something, or all if there are fewer.

    Pages of any length are chosen by a hash of their text, and cut to runs of blocks where they are read, so that
    the work is bounded by the number of blocks. If too few of the first choice teach anything, more are read. Where
    no page of the table names an article the labeller stays unlearned, and refuses pages that have blocks.
    """
    total = pages.count()
    share = F.pmod(F.xxhash64(col(html), F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, place in zip(batch["html"], batch["place"]):
                runs = runs_of(blocks_of(page), np.random.default_rng(place % (1 << 32)))
                if runs:
                    yield pd.DataFrame({"place": [place], "runs": [pickle.dumps(runs)]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [run for batch in batches for page in batch["runs"] for run in pickle.loads(page)]
        yield pd.DataFrame({"model": [pickle.dumps(Labeller().fit(found))]})

    wanted = 1.5 * FIT_PAGES / max(1, total)
    while True:
        chosen = pages.filter(share < wanted).select(col(html).alias("html"), F.xxhash64(col(html)).alias("place"))
        teaching = materialize(chosen.mapInPandas(cut, "place long, runs binary"), "teaching-pages")
        if wanted >= 1 or teaching.count() >= FIT_PAGES:
            break
        wanted *= 8
    sample = teaching.orderBy("place", "runs").limit(FIT_PAGES)
    learned = sample.coalesce(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else Labeller()


def main_text(pages: DataFrame, model: Labeller, *, html: str = "html") -> Column:
    """Column with the text of all blocks that are article, in page order, joined by a space; empty if there is none.

    Null and empty pages, and pages without a text block, give an empty text. Whole pages are read.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors()
        for batch in batches:
            out: list[str] = []
            for first in range(0, len(batch), 256):
                parsed = [blocks_of(p) for p in batch.iloc[first : first + 256]]
                for blocks, belief in zip(parsed, held.value.label(parsed, vectors)):
                    out.append(" ".join(b.text for b, x in zip(blocks, belief) if x > 0.5))
            yield pd.Series(out, dtype=object)

    return extract(col(html))
