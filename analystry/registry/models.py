"""Classifiers on embeddings: every query returns per-class counts of right answers on held-out rows."""

from pyspark.sql import functions as F

from analystry.operators import models as M
from analystry.operators.logistic_tree import LogisticTree
from analystry.registry.book import query, rounded
from analystry.session import table

CLASSES = 10


def vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf_dir, "embeddings")
    df = e.select("vec_id", F.col("label").cast("int").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    held_out = F.col("vec_id") % 3 == 0
    return df.where(~held_out), df.where(held_out)


def two_class(spark, sf_dir):
    return tuple(d.withColumn("label", (F.col("label") < 5).cast("int")) for d in vectors(spark, sf_dir))


def hits(scored):
    hit = (F.col("prediction") == F.col("label")).cast("long")
    return scored.groupBy("label").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))


@query("model_logistic")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.logistic(train.count()).fit(train).transform(test))


@query("model_logistic_cv")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.logistic_cv(train.count(), maxIter=100).fit(train).transform(test))


@query("model_ridge")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.ridge_classifier(train, CLASSES).transform(test))


@query("model_perceptron")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.online_linear(train, CLASSES, "perceptron").transform(test))


@query("model_passive_aggressive")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.online_linear(train, CLASSES, "passive").transform(test))


@query("model_random_forest")
def _(spark, sf_dir):
    from pyspark.ml.classification import RandomForestClassifier
    train, test = vectors(spark, sf_dir)
    return hits(RandomForestClassifier(numTrees=100, maxDepth=5, seed=0).fit(train).transform(test))


@query("model_linear_svm")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.svm_classifier(train, CLASSES).transform(test))


@query("model_sgd_l2")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.sgd_linear(train, CLASSES, "l2").transform(test))


@query("model_sgd_l1")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.sgd_linear(train, CLASSES, "l1").transform(test))


@query("model_elastic_net")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.sgd_linear(train, CLASSES, "elasticnet").transform(test))


@query("model_l1_then_svm")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.l1_then_svm(train, CLASSES)[1].transform(test))


@query("model_bernoulli_bayes")
def _(spark, sf_dir):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import Binarizer
    train, test = vectors(spark, sf_dir)
    signs = Binarizer(threshold=0.0, inputCol="features", outputCol="bits")
    model = NaiveBayes(modelType="bernoulli", smoothing=0.01, featuresCol="bits").fit(signs.transform(train))
    return hits(model.transform(signs.transform(test)))


@query("model_decision_tree")
def _(spark, sf_dir):
    from pyspark.ml.classification import DecisionTreeClassifier
    train, test = vectors(spark, sf_dir)
    return hits(DecisionTreeClassifier(maxDepth=5, seed=0).fit(train).transform(test))


@query("model_ada_boost")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    return hits(M.ada_boost(train, CLASSES).transform(test))


@query("model_perceptron_net")
def _(spark, sf_dir):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    train, test = vectors(spark, sf_dir)
    return hits(MultilayerPerceptronClassifier(layers=[64, 100, 100, CLASSES], maxIter=30, seed=0).fit(train).transform(test))


@query("model_rbf_svm")
def _(spark, sf_dir):
    train, test = (M.fourier_features(d, "features", "waves", gamma=2.0) for d in two_class(spark, sf_dir))
    return hits(M.svm_classifier(train, 2, features="waves").transform(test))


@query("model_bagging_logistic")
def _(spark, sf_dir):
    train, test = vectors(spark, sf_dir)
    n = train.count()
    return hits(M.bagging(train, lambda: M.logistic(n, maxIter=100), key="vec_id").transform(test))


@query("model_pca_by_variance")
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    train, test = vectors(spark, sf_dir)
    models, _ = M.centred_pca(train, "features", "p", variance=0.99)
    return rounded(M.apply_pca(models, test).select("vec_id", F.size(vector_to_array("p")).alias("kept"),
                                                    F.abs(vector_to_array("p")[0]).alias("first")), 4)


@query("model_feature_elimination")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(64)]
    df = e.select((F.col("label") == 1).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    kept = M.recursive_elimination(df, names, "y", keep=5)
    return df.agg(*[F.round(F.avg(c), 6).alias(c) for c in kept])


@query("model_quadratic_discriminant", """WITH e AS (SELECT vec_id, (label<5)::INTEGER AS label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
m AS (SELECT label, ln(count(*)::DOUBLE/(SELECT count(*) FROM e WHERE vec_id%3<>0)) AS pr, avg(a) ma, avg(b) mb, var_samp(a) sa, var_samp(b) sb, covar_samp(a,b) c
      FROM e WHERE vec_id%3<>0 GROUP BY label),
s AS (SELECT vec_id, m.label AS prediction, pr-0.5*ln(sa*sb-c*c)-0.5*((a-ma)*(a-ma)*sb-2*(a-ma)*(b-mb)*c+(b-mb)*(b-mb)*sa)/(sa*sb-c*c) AS score FROM e, m WHERE vec_id%3=0)
SELECT vec_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, prediction DESC) AS k FROM s) WHERE k=1""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    df = e.select("vec_id", (F.col("label") < 5).cast("int").alias("label"),
                  F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    model = M.quadratic_discriminant(df.where(F.col("vec_id") % 3 != 0), ["a", "b"], "label")
    return M.discriminant_predict(df.where(F.col("vec_id") % 3 == 0), model, ["a", "b"]).select("vec_id", "prediction")


@query("model_logistic_tree")
def _(spark, sf_dir):
    train, test = two_class(spark, sf_dir)
    return hits(LogisticTree().fit(train).transform(test))


@query("model_logistic_tree_lines")
def _(spark, sf_dir):
    return LogisticTree().fit(two_class(spark, sf_dir)[0]).tree_lines(spark)


@query("model_bagged_logistic_tree")
def _(spark, sf_dir):
    train, test = two_class(spark, sf_dir)
    return hits(M.bagging(train, lambda: LogisticTree(maxDepth=2), replicas=2).transform(test))
