"""Checks of the graph: fixed rules, shapes from a table, and the entailment they build on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.scalars import local_name
from kgspark.model import DOMAIN, LABEL, NS, RANGE, RDF, SCHEMA, SUBCLASS, SUBPROPERTY, TRIPLE_COLUMNS, TYPE, Namespaces, checkpointed, edges, match
from kgspark.operators.infer import subclass_closure, with_ancestors

LABELLED = ("Character", "Location", "Artifact")


def _violations(df: DataFrame, kind, message, severity: str) -> DataFrame:
    return df.select(F.col("s").alias("entity"), kind.alias("type"), message.alias("violation"), F.lit(severity).alias("severity"))


def missing_labels(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """Entities of the three main classes without a label."""
    own = match(graph, p=TYPE).filter(F.col("o").isin(*[ns.ont + c for c in LABELLED])).select("s", local_name(F.col("o")).alias("type")).distinct()
    return _violations(own.join(edges(graph, LABEL), "s", "left_anti"), F.col("type"), F.lit("Missing required rdfs:label"), "error")


def _characters(graph: DataFrame, ns: Namespaces) -> DataFrame:
    return match(graph, p=TYPE, o=ns.ont + "Character").select("s").distinct()


def invalid_gender(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    value = F.lower("o")
    own = match(graph, p=SCHEMA + "gender").filter(~value.isin("male", "female")).select("s", "o")
    return _violations(own.join(_characters(graph, ns), "s", "left_semi"), F.lit("Character"), F.concat(F.lit("Invalid gender value: "), value), "warning")


def non_iri_parent(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    own = match(graph, p=SCHEMA + "parent").filter("o_kind <> 'iri'").select("s", "o_kind")
    message = F.concat(F.lit("schema:parent should be a URI, got: "), F.initcap("o_kind"))
    return _violations(own.join(_characters(graph, ns), "s", "left_semi"), F.lit("Character"), message, "warning")


def violations(graph: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """All rows of the fixed rules."""
    return missing_labels(graph, ns).unionByName(invalid_gender(graph, ns)).unionByName(non_iri_parent(graph, ns))


def conforms(found: DataFrame) -> DataFrame:
    """One row: whether there is no error; warnings don't count."""
    return found.agg((F.count_if(F.col("severity") == "error") == 0).alias("conforms"))


def validation_report(graph: DataFrame, found: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """One row: size, entities of the main classes, errors, warnings, conforms."""
    of = lambda cls: F.count_if((F.col("p") == TYPE) & (F.col("o") == cls))
    sizes = graph.agg(
        F.count("*").alias("triples"), of(ns.ont + "Character").alias("characters"), of(ns.ont + "Location").alias("locations"),
        of(ns.ont + "Artifact").alias("artifacts"), of(SCHEMA + "Event").alias("events"), F.lit(1).alias("one"),
    )
    split = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.lit(1).alias("one"))
    return sizes.join(split, "one").drop("one").withColumn("conforms", F.col("errors") == 0)


def shacl_validate(graph: DataFrame, shapes: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """Violations of a constraint table (entity, path, constraint, value), all constraints in one pass.

    Targets are instances of a shape's class or of a subclass. The constraints of each type come from the table and the class
    closure alone; they are numbered, so targets and values are (subject, number), counted together in one aggregation. Of
    values only those that are counted or break a rule are rows of it.
    """
    closure = subclass_closure(graph)
    constraint = ["path", "constraint", "value"]
    numbered = checkpointed(shapes.select(*constraint).distinct().withColumn("id", F.monotonically_increasing_id()))
    below = shapes.join(closure, F.col("ancestor") == F.col("target_class")).select(F.col("class").alias("type"), *constraint)
    of_type = checkpointed(below.unionByName(shapes.select(F.col("target_class").alias("type"), *constraint)).join(numbered, constraint).select("type", "id").distinct())
    targets = edges(graph, TYPE, "s", "type").join(of_type, "type").select("s", "id", F.lit(1).alias("target"), F.lit(0).alias("n"))
    datatype = F.when(F.col("o_kind") == "literal", F.coalesce("o_dt", F.when(F.col("o_lang").isNotNull(), RDF + "langString").otherwise("http://www.w3.org/2001/XMLSchema#string"))).otherwise("iri")
    counted = (
        F.when(F.col("constraint").isin("minCount", "maxCount"), True)
        .when(F.col("constraint") == "datatype", datatype != F.col("value"))
        .when(F.col("constraint") == "nodeKind", F.col("o_kind") != "iri")
        .when(F.col("constraint") == "in", ~F.array_contains(F.split("value", " "), F.col("o")))
    )
    values = graph.join(numbered.withColumnRenamed("path", "p"), "p").filter(counted).select("s", "id", F.lit(0).alias("target"), F.lit(1).alias("n"))
    each = targets.unionByName(values).groupBy("s", "id").agg(F.max("target").alias("target"), F.sum("n").alias("n")).filter("target = 1")
    wrong = (
        F.when(F.col("constraint") == "minCount", F.col("n") < F.col("value").cast("int"))
        .when(F.col("constraint") == "maxCount", F.col("n") > F.col("value").cast("int"))
        .otherwise(F.col("n") > 0)
    )
    return each.join(numbered, "id").filter(wrong).select(F.col("s").alias("entity"), *constraint)


def _entailed(rows: DataFrame, up: DataFrame, schema: DataFrame, classes: DataFrame) -> DataFrame:
    """What subproperties, domains, ranges and subclasses entail from ``rows`` in one pass each, in this order."""
    wider = rows.join(up, "p").select("s", F.col("super").alias("p"), "o", "o_kind", "o_dt", "o_lang")
    stated = rows.unionByName(wider)
    domain = stated.join(edges(schema, DOMAIN, "p", "cls"), "p").select(F.col("s").alias("entity"), F.col("cls").alias("type"))
    range_ = stated.filter("o_kind = 'iri'").join(edges(schema, RANGE, "p", "cls"), "p").select(F.col("o").alias("entity"), F.col("cls").alias("type"))
    types = edges(stated, TYPE, "entity", "type").unionByName(domain).unionByName(range_).distinct()
    typed = with_ancestors(types, classes).select(F.col("entity").alias("s"), F.lit(TYPE).alias("p"), F.col("class").alias("o"), F.lit("iri").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_dt", "o_lang")])
    return wider.unionByName(typed)


def rdfs_materialize(graph: DataFrame, ontology: DataFrame) -> DataFrame:
    """The graph with what subproperties, domains, ranges and subclasses entail, as a fixpoint.

    Semi-naive: each round derives from what the round before has added, and what is known
    already is left out. In the order of ``_entailed`` the first round gives all that a common
    vocabulary entails, so the second one, over the new triples alone, is the last. If new triples
    belong to the vocabulary itself, as under a property below rdfs:subClassOf, its closures are
    made anew and the next round starts from all triples. New triples are types or have a superproperty,
    so they are held against the triples of these predicates alone; the graph is shuffled once, to make it a set.
    """
    vocabulary = F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)
    own = known = fresh = graph.select(*TRIPLE_COLUMNS)
    more: list[DataFrame] = []
    schema, grown = checkpointed(ontology.select(*TRIPLE_COLUMNS).unionByName(graph.filter(vocabulary).select(*TRIPLE_COLUMNS)).dropDuplicates()), True
    while True:
        if grown:
            up = subclass_closure(schema, SUBPROPERTY).select(F.col("class").alias("p"), F.col("ancestor").alias("super")).filter("p <> super")
            classes = subclass_closure(schema)
            made = [TYPE, *[r["super"] for r in up.select("super").distinct().collect()]]  # of the vocabulary, not of the data
        fresh = checkpointed(_entailed(known if grown else fresh, up, schema, classes).subtract(known.filter(F.col("p").isin(made))))
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, more, own.dropDuplicates())
        more.append(fresh)
        known = known.unionByName(fresh)
        added = fresh.filter(vocabulary)
        grown = not added.isEmpty()
        if grown:
            schema = checkpointed(schema.unionByName(added).dropDuplicates())


def report_lines(found: DataFrame) -> DataFrame:
    """(line): one line per violation, and one that says whether the graph conforms."""
    lines = found.select(F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), "entity", F.lit(": "), "violation").alias("line"))
    return conforms(found).select(F.concat(F.lit("Conforms: "), F.col("conforms").cast("string")).alias("line")).unionByName(lines)


def top_violations(found: DataFrame, most: int = 10) -> DataFrame:
    """The first violations of each severity, by local name, with the number of all."""
    order = W.partitionBy("severity").orderBy("entity", "violation")
    first = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)  # Spark keeps the first ones of each task
    totals = found.groupBy("severity").agg(F.count("*").alias("total"))
    return first.join(totals, "severity").select("severity", "n", local_name(F.col("entity")).alias("name"), "violation", (F.col("total") - most).alias("remaining"))
