from hypothesis import given
from hypothesis import strategies as st

from tendril.functions import similarity as S

WORDS = st.lists(st.text("абвx", min_size=1, max_size=5), min_size=1, max_size=5).map(" ".join)


def naive_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_common_is_the_longest_subsequence(a, b):
    assert S.common(a, b) == naive_common(a, b)


@given(WORDS, WORDS)
def test_score_is_symmetric_and_bounded(a, b):
    assert 0 <= S.name_score(a, b) <= 100
    assert abs(S.name_score(a, b) - S.name_score(b, a)) < 1e-9


@given(WORDS, WORDS)
def test_a_subset_of_words_scores_100(a, b):
    assert S.name_score(a, f"{b} {a}") == 100.0 and S.name_score(a, a) == 100.0


@given(WORDS, WORDS)
def test_floors_spare_work_only(a, b):
    full = max(S.word_set_ratio(a, b), S.word_sort_ratio(a, b), S.weighted_ratio(a, b))
    assert abs(S.name_score(a, b) - full) < 1e-9


def test_known_values():
    assert S.ratio("this is a test", "this is a test!") == 200 * 14 / 29
    assert S.window_ratio("test", "this is a test!") == 100.0
    assert S.name_score("", "x") == 0.0 == S.name_score(None, "x")
    assert S.word_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
