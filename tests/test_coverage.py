
from tillroll.plans.coverage import DESCRIBED_IDS, NAMED_IDS, WITHOUT_SQL
from tillroll.plans.registry import ORACLE_SQL, QUERIES


def test_all_ids_covered():
    assert sorted(NAMED_IDS) == [f"Q{i:02d}" for i in range(1, 91)]
    assert sorted(DESCRIBED_IDS) == [f"D{i:02d}" for i in range(1, 53)]
    mapped = [k for ks in list(NAMED_IDS.values()) + list(DESCRIBED_IDS.values()) for k in ks]
    assert len(mapped) == len(set(mapped))
    assert set(mapped) == set(QUERIES) == set(ORACLE_SQL) | WITHOUT_SQL
