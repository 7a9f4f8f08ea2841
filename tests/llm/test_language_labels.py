import numpy as np

from evispark.llm import language


def test_more_than_128_languages():
    scores = np.zeros((4, 300))
    scores[np.arange(4), [299, 299, 128, 127]] = 1e6
    assert language.viterbi(scores, np.array([2, 2])).tolist() == [299, 299, 128, 127]
