"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "Mo", "ke", "é", "nu", "ß", "lo7"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 60, 200, 400, 90, 120, 1, 13)]
    passage = prose(rng, 110)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[3]), (21, base[3]), (22, base[3] + " extra words here"), (22, base[3] + " extra words here"), (23, base[2].upper()), (24, base[2] + " tail " + prose(rng, 6))]
    out += [(30 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 30)) for i in range(6)]
    out += [(40, None), (41, ""), (42, " \n\t "), (43, "ha " * 500), (44, "a" * 3000), (45, "ha " * 480 + "end"), (46, "漢字仮名" * 250), (None, base[3]), (None, None), (47, "!!! ... 123"), (-5, base[4] + "\n" + base[5]), (22, "another text under an id that repeats " * 3)]
    out += [(48, prose(rng, 6000) + " " + passage), (49, "Released under the MIT License.\nunder the mit license, apache license version 2; cc-by-nc\nThis work is licensed under the GNU General Public License, version 3.")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(d, t, "en" if (d or 0) % 2 else None, "s", len(t) if t else None, 1.5, "x", 3, 4, "y") for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, id string, n_words int, label int, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
