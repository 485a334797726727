import zipfile

from knowmill import shipping


def test_ships_once_where_workers_would_not_see_the_package(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(shipping, "_SHIPPED", set())
    monkeypatch.setattr(shipping, "_workers_see_it", lambda s: False)
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    shipping.ship(spark)
    shipping.ship(spark)
    assert len(sent) == 1 and "knowmill/operators/packed.py" in zipfile.ZipFile(sent[0]).namelist()
