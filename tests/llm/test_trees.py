import numpy as np

from graphloom.llm.trees import BaggedTrees, BoostedTrees


def test_held_out_accuracy():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    for model in (BaggedTrees.fit(x[:2000], y[:2000]), BoostedTrees.fit(x[:2000], y[:2000])):
        assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
