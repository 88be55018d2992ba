"""Services: the engine's operators behind the calls of an online-learning server, one class each.

A service's state is a set of tables. Each change writes the next version of a table below ``path`` (a folder that all
machines share) and reads it back, so plans stay short and a lost executor costs no more than one change. Calls take many
records at once as DataFrames: features are (row_id, feature, value), ids and labels as named. ``convert`` makes features of
raw records with the rules of the configuration's ``converter``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.lineage import cut
from fluxloom.operators import anomaly, bandit, burst, clustering, features as X, graph, learners, lsh_index, similarity as S, stat, state
from fluxloom.plans import config as C


#: What the converter keeps of the records that a service has learnt from.
STATISTICS = {"frequencies": "feature string, df double", "size": "n long", "groups": "group_key string, freq double, total double", "user_weights": "feature string, weight double"}


class Service:
    """Configuration and versioned tables; a change writes its table's next version and drops the one before the last."""

    service: str
    tables: dict[str, str] = {}
    method = ""

    def __init__(self, spark: SparkSession, path: str, parameters: dict | None = None, converter: dict | None = None, unlearner: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.p = C.parameters(self.service, parameters)
        self.converter = C.converter(converter) if converter is not None else X.Converter()
        self.tables = dict(self.tables)
        if converter is not None:
            self.tables |= STATISTICS
        self.unlearner = None
        if unlearner is not None:
            self.unlearner = C.parameters("unlearner", unlearner)
            self.tables["touched"] = "key string, turn long"
        self.clear()

    def clear(self) -> None:
        self.versions = dict.fromkeys(self.tables, 0)
        self._held = {name: self.spark.createDataFrame([], schema) for name, schema in self.tables.items()}

    def get(self, name: str) -> DataFrame:
        return self._held[name]

    def put(self, name: str, df: DataFrame) -> None:
        version = self.versions[name] + 1
        target = f"{self.path}/{name}/version={version}"
        df.write.mode("overwrite").parquet(target)
        self._held[name], self.versions[name] = self.spark.read.schema(df.schema).parquet(target), version
        if version > 2:  # readers of the version before may still run
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/version={version - 2}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def convert(self, strings: DataFrame | None = None, nums: DataFrame | None = None, binaries: DataFrame | None = None) -> DataFrame:
        """Features of records (row_id, key, value), weighted with the statistics so far, which do not change."""
        if "size" not in self.tables:
            return self.converter.convert(strings, nums, binaries=binaries)
        n = self.get("size").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self.converter.convert(strings, nums, n=n, frequencies=self.get("frequencies"), weights=self.get("user_weights"), groups=self.get("groups"), binaries=binaries)

    def update_statistics(self, strings: DataFrame | None = None, nums: DataFrame | None = None, binaries: DataFrame | None = None) -> None:
        """Counts records: how many, how many have each feature, and the lengths of groups."""
        parts = [f for _, f in self.converter.unweighted(strings, nums, binaries)]
        every = cut(reduce(DataFrame.unionByName, [f.select("row_id", "feature", "value", "group_key") for f in parts]))
        self.put("frequencies", state.add_up(self.get("frequencies").unionByName(X.document_frequency(every)), ["feature"], ["df"]))
        self.put("groups", state.add_up(self.get("groups").unionByName(X.group_lengths(every)), ["group_key"], ["freq", "total"]))
        counted = X.record_ids(strings, nums, binaries).agg(F.count("*").alias("n"))
        self.put("size", self.get("size").unionByName(counted).agg(F.sum("n").alias("n")))

    def learn(self, strings: DataFrame | None = None, nums: DataFrame | None = None, binaries: DataFrame | None = None) -> DataFrame:
        """Counts the records, then gives their features: what train, set and add calls take."""
        if "size" in self.tables:
            self.update_statistics(strings, nums, binaries)
        return self.convert(strings, nums, binaries)

    def add_weight(self, weights: DataFrame) -> None:
        """``weights``: feature (key$token@rule, without weights' names), weight; they replace those given before."""
        new = weights.select("feature", F.col("weight").cast("double"))
        self.put("user_weights", self.get("user_weights").join(new.select("feature"), "feature", "left_anti").unionByName(new))

    def _remember(self, keys: DataFrame, column: str) -> DataFrame | None:
        """After a touch of keys: the keys that stay, of at most max_size; None without an unlearner."""
        if self.unlearner is None:
            return None
        turn = self.versions["touched"] + 1
        new = keys.select(F.col(column).cast("string").alias("key")).distinct().withColumn("turn", F.lit(turn).cast("long"))
        every = self.get("touched").unionByName(new)
        most, sticky = int(self.unlearner["max_size"]), self.unlearner["sticky_pattern"]
        if self.unlearner["method"] == "random":
            stay = state.keep_random_but(every, "key", "turn", turn, most, int(self.unlearner["seed"]))
        else:
            stay = state.keep_recent(every, "key", "turn", most, sticky)
        self.put("touched", every.groupBy("key").agg(F.max("turn").alias("turn")).join(stay.select("key"), "key", "left_semi"))
        return self.get("touched").select(F.col("key").alias(column))

    def get_status(self) -> dict[str, str]:
        return state.status(**{f"{name}_version": v for name, v in self.versions.items()}, **{f"num_{name}": self.get(name).count() for name in self.tables})

    def get_versions(self) -> dict[str, int]:
        return dict(self.versions)

    def save(self, path: str) -> None:
        state.save_model({name: self.get(name) for name in self.tables}, path, service=self.service, method=self.method)

    def load(self, path: str) -> None:
        for name, df in state.load_model(self.spark, path, list(self.tables), service=self.service, method=self.method).items():
            self.put(name, df)


class _Signatures:
    """Signatures of rows of features by one of the methods lsh, minhash and euclid_lsh, and the nearest by them."""

    def __init__(self, engine: str, bits: int):
        if engine not in ("lsh", "minhash", "euclid_lsh"):
            raise ValueError(f"unknown method {engine}")
        self.engine, self.bits = engine, bits

    def sign(self, features: DataFrame) -> DataFrame:
        return S.minhash_signatures(features, self.bits) if self.engine == "minhash" else S.lsh_signatures(features, self.bits)

    def nearest(self, rows: DataFrame, queries: DataFrame, k: int | None, others_only: bool = False) -> DataFrame:
        """query_id, row_id, score, rank (with a k)."""
        own = self.sign(rows)
        return S.signature_top_k(own, own if queries is rows else self.sign(queries), k, self.bits, self.engine == "euclid_lsh", "asc", others_only)

    @property
    def kind(self) -> str:
        """How distances come from scores: 1 - similarity, or minus the score."""
        return "euclidean" if self.engine == "euclid_lsh" else "cosine"


def _maps(features: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """seq, target, features of labelled rows; ``target`` is (row_id, label or target, seq)."""
    held = features.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
    none = F.create_map().cast("map<string,double>")
    return target.join(held, "row_id", "left").select("seq", F.col(column).alias("target"), F.coalesce("features", none).alias("features"))


class Classifier(Service):
    """Linear methods; exact neighbours with "cosine" and "euclidean"; or "nearest_neighbor", by the signatures of ``engine``.
    An unlearner forgets labels of linear methods, and rows of the others."""

    service = "classifier"
    tables = {"weights": learners.MODEL, "labels": "label string, n long", "rows": "row_id string, feature string, value double, label string"}

    def __init__(self, spark, path, method: str = "AROW", parameters: dict | None = None, converter: dict | None = None, neighbours: int = 10, sensitivity: float = 1.0, shards: int = 1, engine: str = "euclid_lsh", unlearner: dict | None = None):
        self.method, self.k, self.alpha, self.shards = method, neighbours, sensitivity, shards
        if method not in (*learners.CLASSIFIERS, "cosine", "euclidean", "nearest_neighbor"):
            raise ValueError(f"unknown method {method}")
        super().__init__(spark, path, parameters, converter, unlearner)
        self.signed = _Signatures(engine, int(self.p["hash_num"])) if method == "nearest_neighbor" else None

    def _count(self, labels: DataFrame) -> None:
        self.put("labels", state.add_up(self.get("labels").unionByName(labels), ["label"], ["n"]))

    def train(self, features: DataFrame, labels: DataFrame) -> None:
        """``labels``: row_id, label, seq (the order of training)."""
        self._count(labels.groupBy("label").agg(F.count("*").alias("n")))
        if self.method in learners.CLASSIFIERS:
            method, c = self.method, self.p["regularization_weight"]
            self.put("weights", learners.train(_maps(features, labels, "label"), lambda: learners.Classifier(method, c), self.shards, self.get("weights")))
            stay = self._remember(labels, "label")
            for name in ("weights", "labels") if stay is not None else ():
                self.put(name, self.get(name).join(stay, "label", "left_semi"))
        else:
            new = features.join(labels.select("row_id", "label"), "row_id").select(F.col("row_id").cast("string"), "feature", "value", "label")
            every, stay = self.get("rows").unionByName(new), self._remember(labels, "row_id")
            self.put("rows", every if stay is None else every.join(stay, "row_id", "left_semi").select(*every.columns))

    def classify(self, features: DataFrame) -> DataFrame:
        """row_id, label, score of every known label."""
        if self.method in learners.CLASSIFIERS:
            return learners.classify(features, self.get("weights"), self.get("labels"))
        rows = self.get("rows")
        if self.signed:
            near, kind = self.signed.nearest(rows, features, self.k), self.signed.kind
        else:
            near, kind = (S.cosine_scores(rows, features, self.k) if self.method == "cosine" else S.euclidean_scores(rows, features, k=self.k)), self.method
        votes = S.vote(near, rows.select("row_id", "label").distinct(), self.get("labels"), self.alpha, kind)
        return votes.withColumnRenamed("query_id", "row_id")

    def get_labels(self) -> DataFrame:
        return self.get("labels")

    def set_label(self, label: str) -> bool:
        if not self.get("labels").filter(F.col("label") == label).isEmpty():
            return False
        self._count(self.spark.createDataFrame([(label, 0)], "label string, n long"))
        return True

    def delete_label(self, label: str) -> bool:
        known = not self.get("labels").filter(F.col("label") == label).isEmpty()
        for name in self.tables if known else ():
            self.put(name, self.get(name).filter(F.col("label") != label))
        return known


class Regression(Service):
    """Linear methods, exact neighbours with "cosine" and "euclidean", or "nearest_neighbor" by the signatures of ``engine``."""

    service = "regression"
    tables = {"weights": learners.MODEL, "rows": "row_id string, feature string, value double, target double", "seen": "n double, sum double, sq double"}

    def __init__(self, spark, path, method: str = "PA", parameters: dict | None = None, converter: dict | None = None, shards: int = 1, engine: str = "euclid_lsh", unlearner: dict | None = None):
        self.method, self.shards = method, shards
        super().__init__(spark, path, parameters, converter, unlearner)
        self.signed = _Signatures(engine, int(self.p["hash_num"])) if method == "nearest_neighbor" else None

    def train(self, features: DataFrame, targets: DataFrame) -> None:
        """``targets``: row_id, target, seq."""
        if self.method in ("cosine", "euclidean", "nearest_neighbor"):
            new = features.join(targets.select("row_id", "target"), "row_id").select(F.col("row_id").cast("string"), "feature", "value", "target")
            every, stay = self.get("rows").unionByName(new), self._remember(targets, "row_id")
            return self.put("rows", every if stay is None else every.join(stay, "row_id", "left_semi").select(*every.columns))
        method, p = self.method, self.p
        seen = tuple(self.get("seen").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("n", "sum", "sq")]).first())
        make = lambda: learners.Regression(method, p["regularization_weight"], p["sensitivity"], p["learning_rate"], seen)
        self.put("weights", learners.train(_maps(features, targets, "target"), make, self.shards, self.get("weights")))
        y = F.col("target")
        new = targets.agg(F.count(y).cast("double").alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("sq"))
        return self.put("seen", self.get("seen").unionByName(new).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "sq")]))

    def estimate(self, features: DataFrame) -> DataFrame:
        """row_id, estimate."""
        if self.method in ("cosine", "euclidean", "nearest_neighbor"):
            rows, k = self.get("rows"), self.p["nearest_neighbor_num"]
            if self.signed:
                near, kind = self.signed.nearest(rows, features, k), self.signed.kind
            else:
                near, kind = (S.cosine_scores(rows, features, k) if self.method == "cosine" else S.euclidean_scores(rows, features, k=k)), self.method
            found = S.neighbour_mean(near, rows.select("row_id", "target").distinct(), self.p["weight"], kind)
            return found.withColumnRenamed("query_id", "row_id")
        known = self.spark.createDataFrame([("+",)], "label string")
        return learners.classify(features, self.get("weights"), known).select("row_id", F.col("score").alias("estimate"))


class Recommender(Service):
    """Rows of features and what is similar to them: inverted_index, inverted_index_euclid, lsh, minhash, euclid_lsh, or
    nearest_neighbor_recommender, by the signatures of ``engine``. An unlearner forgets rows."""

    service = "recommender"
    tables = {"rows": "row_id string, feature string, value double"}

    def __init__(self, spark, path, method: str = "inverted_index", parameters: dict | None = None, converter: dict | None = None, engine: str = "euclid_lsh", unlearner: dict | None = None):
        if method not in ("inverted_index", "inverted_index_euclid", "lsh", "minhash", "euclid_lsh", "nearest_neighbor_recommender"):
            raise ValueError(f"unknown method {method}")
        self.method = method
        super().__init__(spark, path, parameters, converter, unlearner)
        exact = method.startswith("inverted_index")
        self.signed = None if exact else _Signatures(engine if method == "nearest_neighbor_recommender" else method, int(self.p["hash_num"]))

    def _put_rows(self, every: DataFrame, touched: DataFrame) -> None:
        stay = self._remember(touched, "row_id")
        self.put("rows", every if stay is None else every.join(stay, "row_id", "left_semi").select(*every.columns))

    def update_row(self, features: DataFrame) -> None:
        """Given features replace those of the row, its others stay."""
        new = features.select(F.col("row_id").cast("string"), "feature", "value")
        self._put_rows(X.upsert(self.get("rows"), new), new)

    def clear_row(self, ids: DataFrame) -> None:
        self.put("rows", self.get("rows").join(ids.select(F.col("row_id").cast("string")), "row_id", "left_anti"))

    def scores(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, row_id, score; with a k the best of each query."""
        rows = self.get("rows")
        if self.method == "inverted_index":
            return S.cosine_scores(rows, queries, k)
        if self.method == "inverted_index_euclid":
            return S.euclidean_scores(rows, queries, self.p["ignore_orthogonal"], k)
        return self.signed.nearest(rows, queries, None)

    def similar_row_from_datum(self, queries: DataFrame, k: int) -> DataFrame:
        if self.method == "euclid_lsh":
            p = self.p
            return lsh_index.neighbours(self.get("rows"), queries, k, 1 + p["hash_num"] // 16, p["table_num"], p["bin_width"], p["hash_num"], p["seed"], p["probe_num"])
        if self.signed:
            return self.signed.nearest(self.get("rows"), queries, k)
        return S.top_k(self.scores(queries, k), k)

    def _stored(self, ids: DataFrame) -> DataFrame:
        return self.get("rows").join(ids.select(F.col("row_id").cast("string")), "row_id", "left_semi")

    def similar_row_from_id(self, ids: DataFrame, k: int) -> DataFrame:
        return self.similar_row_from_datum(self._stored(ids), k)

    def similar_row_from_datum_and_score(self, queries: DataFrame, score: float) -> DataFrame:
        return S.at_least(self.scores(queries), score)

    def similar_row_from_id_and_score(self, ids: DataFrame, score: float) -> DataFrame:
        return self.similar_row_from_datum_and_score(self._stored(ids), score)

    def similar_row_from_datum_and_rate(self, queries: DataFrame, rate: float) -> DataFrame:
        return S.top_rate(self.scores(queries), rate, self.get_all_rows().count())

    def similar_row_from_id_and_rate(self, ids: DataFrame, rate: float) -> DataFrame:
        return self.similar_row_from_datum_and_rate(self._stored(ids), rate)

    def complete_row_from_datum(self, queries: DataFrame) -> DataFrame:
        return S.complete(self.similar_row_from_datum(queries, 128), self.get("rows"))

    def complete_row_from_id(self, ids: DataFrame) -> DataFrame:
        return self.complete_row_from_datum(self._stored(ids))

    def decode_row(self, ids: DataFrame) -> DataFrame:
        return X.revert(self._stored(ids))

    def get_all_rows(self) -> DataFrame:
        return self.get("rows").select("row_id").distinct()

    @staticmethod
    def calc_similarity(a: DataFrame, b: DataFrame) -> float:
        return S.pair_cosine(a, b).first()[0]

    @staticmethod
    def calc_l2norm(features: DataFrame) -> DataFrame:
        return S.norms(features)


class NearestNeighbor(Recommender):
    """Signatures only: lsh, minhash or euclid_lsh; a row is replaced as a whole. Ties go to the smaller id."""

    service = "nearest_neighbor"

    def __init__(self, spark, path, method: str = "lsh", parameters: dict | None = None, converter: dict | None = None, unlearner: dict | None = None):
        if method not in ("lsh", "minhash", "euclid_lsh"):
            raise ValueError(f"unknown method {method}")
        super().__init__(spark, path, method, parameters, converter, unlearner=unlearner)

    def set_row(self, features: DataFrame) -> None:
        new = features.select(F.col("row_id").cast("string"), "feature", "value")
        self._put_rows(self.get("rows").join(new.select("row_id").distinct(), "row_id", "left_anti").unionByName(new), new)

    def similar_row_from_datum(self, queries: DataFrame, k: int) -> DataFrame:
        return self.signed.nearest(self.get("rows"), queries, k)

    def neighbor_row_from_datum(self, queries: DataFrame, k: int) -> DataFrame:
        distance = -F.col("score") if self.method == "euclid_lsh" else 1 - F.col("score")
        return self.similar_row_from_datum(queries, k).select("query_id", "row_id", distance.alias("distance"), "rank")

    def neighbor_row_from_id(self, ids: DataFrame, k: int) -> DataFrame:
        return self.neighbor_row_from_datum(self._stored(ids), k)


class Anomaly(Service):
    """Local outlier factors over dense rows (row_id, x): engine "exact", or neighbours by the signatures lsh, minhash and
    euclid_lsh. ``method`` tells the rule of densities: "lof" adds 1e-15 to sums of distances, "light_lof" has infinite ones.

    When rows change, the densities of all rows are computed again, which is what updates of ever more reverse neighbours
    come to; so reverse_nearest_neighbor_num is checked, and has no other effect. With ignore_kth_same_point a row whose
    k - 1 nearest are all at distance 0 is not taken, and counted as ignored. An unlearner forgets rows.
    """

    service = "anomaly"
    tables = {"rows": "row_id string, x array<double>", "density": "row_id string, kdist double, lrd double", "scores": "row_id string, score double"}

    def __init__(self, spark, path, method: str = "light_lof", parameters: dict | None = None, converter: dict | None = None, engine: str = "exact", unlearner: dict | None = None):
        if method not in ("lof", "light_lof"):
            raise ValueError(f"unknown method {method}")
        self.method, self.floor = method, 1e-15 if method == "lof" else None
        super().__init__(spark, path, parameters, converter, unlearner)
        self.signed = None if engine == "exact" else _Signatures(engine, int(self.p["hash_num"]))

    def clear(self) -> None:
        super().clear()
        self.num_ignored = 0

    @staticmethod
    def _features(rows: DataFrame) -> DataFrame:
        return rows.select("row_id", F.posexplode("x").alias("at", "value")).select("row_id", F.concat(F.lit("f"), "at").alias("feature"), "value")

    def _nearest(self, rows: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
        """row_id, neighbour, distance: of each row (others) or query."""
        if self.signed is None:
            return S.nearest_of_all(rows, k, queries=queries).select("row_id", "neighbour", "distance")
        own = self._features(rows)
        found = self.signed.nearest(own, own if queries is None else self._features(queries), k, queries is None)
        distance = 1 - F.col("score") if self.signed.kind == "cosine" else -F.col("score")
        return found.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbour"), distance.alias("distance"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds or replaces rows; gives row_id, score of those that are taken."""
        new = rows.select(F.col("row_id").cast("string"), F.col("x").cast("array<double>"))
        kept = self.get("rows").join(new.select("row_id"), "row_id", "left_anti")
        if self.p["ignore_kth_same_point"]:
            given, key = new.count(), "x"
            if self.signed is not None:  # the same point is one of the same signature
                key = [c for c in ("bits", "norm") if c == "bits" or self.signed.kind == "euclidean"]
                kept, new = (df.join(self.signed.sign(self._features(df)).select("row_id", *key), "row_id") for df in (kept, new))
            new = cut(anomaly.without_kth_same(kept, new, self.p["nearest_neighbor_num"], key).select("row_id", "x"))
            kept = kept.select("row_id", "x")
            self.num_ignored += given - new.count()
        every, stay = kept.unionByName(new), self._remember(new, "row_id")
        self.put("rows", every if stay is None else every.join(stay, "row_id", "left_semi"))
        self._refresh()
        return self.get("scores").join(new.select("row_id"), "row_id", "left_semi")

    update = overwrite = add_bulk = add

    def _refresh(self) -> None:
        k, rows = self.p["nearest_neighbor_num"], self.get("rows")
        pairs = cut(self._nearest(rows, k + 1).unionByName(rows.select("row_id", F.col("row_id").alias("neighbour"), F.lit(0.0).alias("distance"))))
        kdist = anomaly.k_distance(pairs, k)
        self.put("density", kdist.join(anomaly.local_density(pairs, kdist, k, self.floor), "row_id").select("row_id", "kdist", "lrd"))
        self.put("scores", anomaly.stored_scores(pairs, k, self.floor).withColumnRenamed("lof", "score"))

    def clear_row(self, ids: DataFrame) -> None:
        self.put("rows", self.get("rows").join(ids.select(F.col("row_id").cast("string")), "row_id", "left_anti"))
        self._refresh()

    def calc_score(self, queries: DataFrame) -> DataFrame:
        """query_id, lof of records (query_id, x) that are not stored."""
        k = self.p["nearest_neighbor_num"]
        asked = queries.select(F.col("query_id").cast("string").alias("row_id"), F.col("x").cast("array<double>"))
        pairs = self._nearest(self.get("rows"), k, asked).withColumnRenamed("row_id", "query_id")
        held = self.get("density")
        return anomaly.scores(pairs, held.select("row_id", "kdist"), held.select("row_id", "lrd"), k, self.floor)

    def get_status(self) -> dict[str, str]:
        return super().get_status() | state.status(num_ignored=self.num_ignored)

    def get_all_rows(self) -> DataFrame:
        return self.get("rows").select("row_id")


class Clustering(Service):
    """k-means, Gaussian mixture or DBSCAN over pushed points (id, x, weight), by Euclidean or cosine distance.

    Each bucket_size pushed points are a bucket, and a revision. With compressor_method "simple" all points stay; with
    "compressive" full buckets become coresets in levels of bucket_length. What other nodes have pushed comes by put_diff.
    """

    service = "clustering"
    tables = {"points": "id long, x array<double>, weight double", "common": "node string, id long, x array<double>, weight double", "bucket": "id long, x array<double>, weight double"}

    def __init__(self, spark, path, method: str = "kmeans", parameters: dict | None = None, converter: dict | None = None):
        if method not in ("kmeans", "gmm", "dbscan"):
            raise ValueError(f"unknown method {method}")
        self.method = method
        super().__init__(spark, path, parameters, converter)
        if self.p["distance"] == "cosine" and method == "gmm":
            raise ValueError("mixtures have no cosine distance")

    def clear(self) -> None:
        super().clear()
        self.revision, self.centers, p = 0, [], self.p
        self.levels = clustering.Coresets(int(p["k"]), "id", int(p["compressed_bucket_size"]), int(p["bucket_length"]), float(p["forgetting_factor"]), float(p["forgetting_threshold"]), mixture=self.method == "gmm", keep=self._keep)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/levels/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def push(self, points: DataFrame) -> None:
        new = points.select(F.col("id").cast("long"), F.col("x").cast("array<double>"), F.col("weight").cast("double"))
        self.put("bucket", self.get("bucket").unionByName(new))
        if self.get("bucket").limit(int(self.p["bucket_size"])).count() >= self.p["bucket_size"]:
            self._close_bucket()
            self.do_clustering()

    def _close_bucket(self) -> None:
        if self.p["compressor_method"] == "compressive":
            self.levels.push(self.get("bucket"))
            self.put("points", self.levels.points())
        else:
            self.put("points", self.get("points").unionByName(self.get("bucket")))
        self.put("bucket", self.get("bucket").limit(0))

    def compress(self) -> None:
        p = self.p
        self.put("points", clustering.coreset(self.all_points(), p["k"], p["compressed_bucket_size"], "id", p["seed"], mixture=self.method == "gmm"))
        self.put("bucket", self.get("bucket").limit(0))

    def all_points(self) -> DataFrame:
        """Own coresets or points, those of the open bucket, and those of other nodes."""
        return self.get("points").unionByName(self.get("bucket")).unionByName(self.get("common").drop("node"))

    def get_diff(self, node: str) -> DataFrame:
        return self.get("points").unionByName(self.get("bucket")).select(F.lit(node).alias("node"), "id", "x", "weight")

    def put_diff(self, node: str, *diffs: DataFrame) -> None:
        """Takes what mix_coresets makes of the nodes' differences: those of others replace what was held of them."""
        self.put("common", clustering.mix_coresets(*diffs).filter(F.col("node") != node).select("node", "id", "x", "weight"))
        self.do_clustering()

    def do_clustering(self) -> DataFrame | None:
        self.revision += 1
        points, p = self.all_points(), self.p
        if self.method == "dbscan":
            return clustering.dbscan(points, p["eps"], p["min_core_point"], kind=p["distance"])
        if self.method == "gmm":
            self.centers = clustering.gmm(points, p["k"], "id", seed=p["seed"])[0].tolist()
        else:
            self.centers = clustering.kmeans(points, p["k"], "id", seed=p["seed"], kind=p["distance"])
        return None

    def get_revision(self) -> int:
        return self.revision

    def get_k_center(self) -> list[list[float]]:
        if not self.centers:
            raise RuntimeError("clustering has not been performed")
        return self.centers

    def get_nearest_center(self, points: DataFrame) -> DataFrame:
        return clustering.assign(points, self.get_k_center(), kind=self.p["distance"])

    def get_nearest_members(self, point: list[float]) -> DataFrame:
        return clustering.members(self.all_points(), self.get_k_center(), point, kind=self.p["distance"])

    def get_core_members(self) -> DataFrame:
        return clustering.assign(self.all_points(), self.get_k_center(), kind=self.p["distance"])


class Burst(Service):
    """Keywords, documents (seq, pos, text) and windows of batches in which keywords burst."""

    service = "burst"
    tables = {"keywords": "keyword string, scaling double, gamma double", "documents": "seq long, pos double, text string", "results": "keyword string, start long, batch long, d long, r long, weight double"}

    def clear(self) -> None:
        super().clear()
        self.processed = None

    def set_processed_keywords(self, keywords: DataFrame | None) -> None:
        """Only these of the registered keywords are counted here; None: all. Results of others are left to other nodes."""
        self.processed = None if keywords is None else keywords.select("keyword").distinct()

    def add_keyword(self, keyword: str, scaling: float, gamma: float) -> bool:
        if scaling <= 1 or gamma <= 0:
            raise ValueError("scaling_param must be over 1 and gamma over 0")
        if not self.get("keywords").filter(F.col("keyword") == keyword).isEmpty():
            return False
        self.put("keywords", self.get("keywords").union(self.spark.createDataFrame([(keyword, float(scaling), float(gamma))], self.tables["keywords"])))
        return True

    def remove_keyword(self, keyword: str) -> bool:
        known = not self.get("keywords").filter(F.col("keyword") == keyword).isEmpty()
        if known:
            self.put("keywords", self.get("keywords").filter(F.col("keyword") != keyword))
        return known

    def remove_all_keywords(self) -> None:
        self.put("keywords", self.get("keywords").limit(0))

    def get_all_keywords(self) -> DataFrame:
        return self.get("keywords")

    def add_documents(self, documents: DataFrame) -> None:
        self.put("documents", self.get("documents").unionByName(documents.select("seq", "pos", "text")))

    def calculate_results(self) -> None:
        size, interval = int(self.p["window_batch_size"]), float(self.p["batch_interval"])
        docs, words = self.get("documents"), self.get("keywords")
        if self.processed is not None:
            words = words.join(self.processed, "keyword", "left_semi")
        placed = burst.place(docs.select("seq", "pos"), interval, size)
        counted = burst.windowed(burst.batch_counts(burst.on_time(docs, placed, interval), words, interval), placed)
        found = burst.results(counted, words, size, int(self.p["max_reuse_batch_num"]), float(self.p["costcut_threshold"]))
        newest = found.select("keyword", "start").distinct()
        newest = state.top_results(newest, "keyword", "start", int(self.p["result_window_rotate_size"]))
        self.put("results", found.join(newest, ["keyword", "start"], "left_semi").select("keyword", "start", "batch", "d", "r", "weight"))

    def get_result(self, keyword: str) -> DataFrame:
        own = self.get("results").filter(F.col("keyword") == keyword)
        return own.join(own.agg(F.max("start").alias("start")), "start", "left_semi")

    def get_result_at(self, keyword: str, pos: float) -> DataFrame:
        batch = int(pos // self.p["batch_interval"])
        own = self.get("results").filter((F.col("keyword") == keyword) & (F.col("start") <= batch) & (F.col("start") + int(self.p["window_batch_size"]) > batch))
        return own.join(own.agg(F.max("start").alias("start")), "start", "left_semi")

    def get_all_bursted_results(self) -> DataFrame:
        newest = self.get("results").groupBy("keyword").agg(F.max_by("weight", F.struct("start", "batch")).alias("last"))
        return newest.filter("last > 0").select("keyword")

    def get_all_bursted_results_at(self, pos: float) -> DataFrame:
        return burst.bursted_at(self.get("results"), int(pos // self.p["batch_interval"]))


class Stat(Service):
    """The last window_size pushes (seq, key, value) over all keys."""

    service = "stat"
    tables = {"window": "seq long, key string, value double"}

    def push(self, pushes: DataFrame) -> None:
        self.put("window", stat.last_pushes(self.get("window").unionByName(pushes.select("seq", "key", "value")), ["seq"], int(self.p["window_size"])))

    def _of(self, key: str, name: str) -> float:
        row = stat.window_summary(self.get("window").filter(F.col("key") == key), "key", "value").select(name).first()
        if row is None:
            raise KeyError(key)
        return row[0]

    def sum(self, key: str) -> float:
        return self._of(key, "sum")

    def max(self, key: str) -> float:
        return self._of(key, "max")

    def min(self, key: str) -> float:
        return self._of(key, "min")

    def stddev(self, key: str) -> float:
        return self._of(key, "stddev")

    def moment(self, key: str, degree: int, center: float) -> float:
        if degree < 0:
            return -1.0
        self._of(key, "n")
        own = self.get("window").filter(F.col("key") == key)
        return own.agg(F.max(F.lit(1.0)) if degree == 0 else stat.moment(F.col("value"), degree, center)).first()[0]

    def entropy(self) -> float:
        return stat.entropy(self.get("window"), "key").first()[0]


class Graph(Service):
    """Property graph with preset queries; centralities move on by one round with each update_index."""

    service = "graph"
    tables = {"nodes": "id long, props map<string,string>", "edges": "eid long, src long, dst long, props map<string,string>"}

    def clear(self) -> None:
        super().clear()
        self.presets, self.rounds = graph.Presets(), 0
        self.scores: dict[str, DataFrame] = {}
        self.trees: dict[str, DataFrame] = {}

    def create_node(self, nodes: DataFrame) -> None:
        self.put("nodes", graph.create_nodes(self.get("nodes"), nodes))

    def update_node(self, changes: DataFrame) -> None:
        self.put("nodes", graph.update(self.get("nodes"), changes))

    def remove_node(self, ids: DataFrame) -> None:
        self.put("nodes", graph.remove_nodes(self.get("nodes"), self.get("edges"), ids))

    def create_edge(self, edges: DataFrame) -> None:
        self.put("edges", graph.create_edges(self.get("nodes"), self.get("edges"), edges))

    def update_edge(self, changes: DataFrame) -> None:
        self.put("edges", graph.update(self.get("edges"), changes, "eid"))

    def remove_edge(self, ids: DataFrame) -> None:
        self.put("edges", self.get("edges").join(ids.select("eid"), "eid", "left_anti"))

    def get_node(self, node: int) -> DataFrame:
        return self.get("nodes").filter(F.col("id") == node)

    def get_edge(self, edge: int) -> DataFrame:
        return self.get("edges").filter(F.col("eid") == edge)

    def add_centrality_query(self, node_query: dict, edge_query: dict) -> None:
        self.presets.add("centrality", node_query, edge_query)

    def add_shortest_path_query(self, node_query: dict, edge_query: dict) -> None:
        self.presets.add("shortest_path", node_query, edge_query)

    def remove_centrality_query(self, node_query: dict, edge_query: dict) -> None:
        self.presets.remove("centrality", node_query, edge_query)

    def remove_shortest_path_query(self, node_query: dict, edge_query: dict) -> None:
        self.presets.remove("shortest_path", node_query, edge_query)

    def _subgraph(self, node_query: dict, edge_query: dict) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.get("nodes"), self.get("edges"), node_query, edge_query)

    def update_index(self) -> None:
        """One more round of each preset centrality, from the scores of the round before, and landmarks' trees that reach one
        hop further."""
        self.rounds += 1
        for kind, node_query, edge_query in self.presets.all():
            key = repr((sorted(node_query.items()), sorted(edge_query.items())))
            nodes, edges = self._subgraph(node_query, edge_query)
            if kind == "centrality":
                self.scores[key] = graph.centrality(nodes, edges, self.p["damping_factor"], 1, self.scores.get(key))
            elif self.p["landmark_num"]:
                self.trees[key] = cut(graph.landmark_trees(nodes, edges, int(self.p["landmark_num"]), self.rounds))

    def get_centrality(self, node_query: dict, edge_query: dict) -> DataFrame:
        """Scores as of the last update_index; 1 for each node before the first."""
        self.presets.check("centrality", node_query, edge_query)
        key = repr((sorted(node_query.items()), sorted(edge_query.items())))
        if key in self.scores:
            return self.scores[key]
        return self._subgraph(node_query, edge_query)[0].select("id", F.lit(1.0).alias("score"))

    def get_shortest_path(self, source: int, target: int, max_hop: int, node_query: dict, edge_query: dict, exact: bool = False) -> list[int]:
        """A path over the best of landmark_num landmarks, as of the last update_index, cut after max_hop edges; with
        ``exact``, or landmark_num 0, a shortest path as of now, [] if it has more edges."""
        self.presets.check("shortest_path", node_query, edge_query)
        key = repr((sorted(node_query.items()), sorted(edge_query.items())))
        edges = self._subgraph(node_query, edge_query)[1]
        if exact or not self.p["landmark_num"]:
            return graph.shortest_path(edges, source, target, max_hop)
        return graph.landmark_path(self.trees[key], edges, source, target, max_hop) if key in self.trees else []


class Bandit(Service):
    """Arms by policy: epsilon_greedy, epsilon_decreasing, ucb1, softmax, exp3 or ts."""

    service = "bandit"
    tables = {"sums": "player string, arm string, trial_count long, weight double", "arms": "arm string", "selected": "player string, arm string"}

    def __init__(self, spark, path, method: str = "epsilon_greedy", parameters: dict | None = None):
        if method not in ("epsilon_greedy", "epsilon_decreasing", "ucb1", "softmax", "exp3", "ts"):
            raise ValueError(f"unknown method {method}")
        self.method = method
        super().__init__(spark, path, parameters)

    def register_arm(self, arm: str) -> bool:
        if not self.get("arms").filter(F.col("arm") == arm).isEmpty():
            return False
        self.put("arms", self.get("arms").union(self.spark.createDataFrame([(arm,)], "arm string")))
        return True

    def delete_arm(self, arm: str) -> bool:
        known = not self.get("arms").filter(F.col("arm") == arm).isEmpty()
        for name in self.tables if known else ():
            self.put(name, self.get(name).filter(F.col("arm") != arm))
        return known

    def reset(self, player: str) -> None:
        self.put("sums", bandit.reset(self.get("sums"), player))

    def _log(self, rows: DataFrame, kind: str) -> None:
        new = rows.select("player", "arm", F.lit(kind).alias("kind"), (F.col("reward") if kind == "reward" else F.lit(0.0)).alias("reward"))
        added = bandit.sums(new.join(self.get("arms"), "arm", "left_semi"), self.p["assume_unrewarded"]).drop("expectation")
        self.put("sums", state.add_up(self.get("sums").unionByName(added), ["player", "arm"], ["trial_count", "weight"]))

    def register_reward(self, rewards: DataFrame) -> None:
        """``rewards``: player, arm, reward; unknown arms do not count. For exp3 a reward is divided by its arm's odds."""
        if self.method == "exp3":
            gamma, table = self.p["gamma"], self._table(rewards)
            odds = bandit.exp3_probabilities(table, gamma).join(table.groupBy("player").agg(F.count("*").alias("k")), "player")
            rewards = rewards.join(odds, ["player", "arm"]).withColumn("reward", F.col("reward") / F.col("probability") * gamma / F.col("k"))
        self._log(rewards, "reward")

    def _table(self, players: DataFrame) -> DataFrame:
        """The sums of all arms for some players, zeros included."""
        names = [r[0] for r in self.get("arms").orderBy("arm").collect()]  # settings
        if not names:
            raise RuntimeError("no arm is registered")
        blank = players.select("player").distinct().select("player", F.explode(F.array(*[F.lit(a) for a in names])).alias("arm"))
        return blank.join(bandit.expectations(self.get("sums")), ["player", "arm"], "left").fillna(0, ["trial_count"]).fillna(0.0, ["weight", "expectation"])

    def get_arm_info(self) -> DataFrame:
        names = [r[0] for r in self.get("arms").collect()]  # settings
        return bandit.register_arms(bandit.expectations(self.get("sums")), names)

    def select_arm(self, players: DataFrame) -> DataFrame:
        """player, arm for each player; what is selected is logged."""
        table = self._table(players)
        p, seed = self.p, int(self.p["seed"]) + self.versions["sums"]
        if self.method == "epsilon_greedy":
            chosen = bandit.epsilon_greedy(table, p["epsilon"], seed)
        elif self.method == "epsilon_decreasing":
            draw = bandit.epsilon_greedy(table, 1.0, seed).withColumnRenamed("arm", "other")
            odds = bandit.decreasing_epsilon(table, p["decreasing_rate"])
            chosen = bandit.greedy(table).join(draw, "player").join(odds, "player").select("player", F.when(F.rand(seed) < F.col("epsilon"), F.col("other")).otherwise(F.col("arm")).alias("arm"))
        elif self.method == "ucb1":
            chosen = bandit.ucb1(table)
        elif self.method == "ts":
            chosen = bandit.thompson(table, seed)
        else:
            odds = bandit.softmax(table, p["tau"]) if self.method == "softmax" else bandit.exp3_probabilities(table, p["gamma"])
            race = odds.withColumn("race", -F.log(1 - F.rand(seed)) / F.col("probability"))
            chosen = race.groupBy("player").agg(F.min_by("arm", "race").alias("arm"))
        self.put("selected", chosen.select("player", "arm"))  # drawn once: what is logged is what is returned
        self._log(self.get("selected"), "select")
        return self.get("selected")


class Weight(Service):
    """Feature weights with document frequencies and groups' lengths that updates count first."""

    service = "weight"

    def __init__(self, spark, path, converter: dict):
        super().__init__(spark, path, None, converter)

    def update(self, strings: DataFrame | None = None, nums: DataFrame | None = None, binaries: DataFrame | None = None) -> DataFrame:
        """Counts the records, then gives their weighted features."""
        return self.learn(strings, nums, binaries)

    calc_weight = Service.convert
