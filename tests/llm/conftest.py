import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SYLLABLES = "ka lo mi ru te sa vo ne pi du".split()
#: Names that operators use inside; a table may have them too.
CLASH = ["fp", "key", "doc", "twin", "bucket", "value", "kind", "score", "size", "block", "mark", "draws", "places", "_runs", "tag", "place", "row",
         "_key", "_text", "_bytes", "rank", "weight", "form", "n", "n_words", "chunk", "maps", "_m", "of", "draw"]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n", ", "]) for w in words).strip()


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose with copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [texts[3], texts[3], texts[3] + " end", texts[5].replace(" ", "  "), texts[6].upper()]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(12)] + [passage, passage[:-3]]
    texts += ["", None, None, " \n\t ", "x", "é", "é" * 300, "a" * 700, "ab" * 400, "the same line\n" * 60, " wide blank 漢字 😀" * 20]
    texts += [prose(rng, 6000)]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows[2] = (*rows[2][:3], None, rows[2][4])
    return rows


def frame(spark, rows):
    """The rows as a table, with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["z"] * len(CLASH)) for r in rows], schema)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
