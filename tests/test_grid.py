from riskmill.operators.models import CANDIDATES, ModelSettings
from riskmill.plans import crossval, queries


def test_grid_queries_cover_every_candidate_with_full_settings(spark, sf_dir, monkeypatch):
    asked = []

    class Stop(Exception):
        pass

    def record(folds, spec, candidates=CANDIDATES, k=5, settings=ModelSettings()):
        asked.append((tuple(candidates), k, settings))
        raise Stop

    monkeypatch.setattr(crossval, "out_of_fold_scores", record)
    for name in ("cv_grid", "cv_grid_trees", "candidate_summary"):
        try:
            queries.all_queries()[name](spark, sf_dir)
        except Stop:
            pass
    trees = tuple(c for c in CANDIDATES if c[0] != queries.LOGISTIC)
    full = ModelSettings()
    assert len(CANDIDATES) == 10
    assert asked == [(CANDIDATES, 5, full), (trees, 5, full), (CANDIDATES, 5, full)]
