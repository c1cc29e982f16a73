"""The fixed vocabulary of the graph, and the shapes that it should have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.model import COMMENT, DOMAIN, INTEGER, LABEL, NS, OWL, RANGE, SCHEMA, SH, SUBCLASS, SUBPROPERTY, TYPE, Namespaces, edges, triples_of

#: Classes with superclass, label and comment.
CLASSES = (
    ("Character", "Person", "Character", "A fictional character of the domain"),
    ("Location", "Place", "Location", None),
    ("Artifact", "Thing", "Artifact", None),
    ("Battle", "Event", "Battle", None),
    ("War", "Event", "War", None),
    ("Race", None, "Race/People", None),
    ("Card", None, "Card", "A card of a collectible card game"),
)
#: Properties with kind, label, and domain, range, superproperty or comment.
PROPERTIES = (
    ("ont:race", "Object", "race", (("domain", "ont:Character"), ("range", "ont:Race"))),
    ("prop:father", "Object", "father", (("super", "schema:parent"),)),
    ("prop:mother", "Object", "mother", (("super", "schema:parent"),)),
    ("prop:realm", "Object", "realm", (("domain", "ont:Location"),)),
    ("prop:destroyedDate", "Datatype", "destroyed date", ()),
    ("prop:result", "Datatype", "result", (("domain", "schema:Event"),)),
    ("prop:objectType", "Datatype", "object type", ()),
    ("prop:ownedBy", "Object", "owned by", ()),
    ("prop:raceLabel", "Datatype", "race label", ()),
    ("prop:card", "Object", "card", (("range", "ont:Card"),)),
    ("prop:cardType", "Datatype", "card type", ()),
    ("prop:cardSet", "Datatype", "card set", ()),
    ("prop:prowess", "Datatype", "prowess", (("range", "xsd:integer"),)),
    ("prop:body", "Datatype", "body", (("range", "xsd:integer"),)),
    ("prop:hairColor", "Datatype", "hair color", ()),
    ("prop:height", "Datatype", "height", ()),
    ("prop:translatedName", "Datatype", "translated name", (("comment", "Name of the entity in a different language"),)),
)
#: Constraints of the extended shapes: class, path, constraint, value.
EXTENDED = (
    ("ont:Character", "rdfs:label", "minCount", "1"), ("ont:Character", "rdfs:label", "datatype", "rdf:langString"), ("ont:Character", "schema:name", "maxCount", "1"),
    ("ont:Character", "schema:gender", "maxCount", "1"), ("ont:Character", "schema:gender", "in", "male female"), ("ont:Character", "ont:race", "nodeKind", "iri"),
    ("ont:Character", "schema:birthDate", "maxCount", "1"), ("ont:Character", "schema:deathDate", "maxCount", "1"),
    ("ont:Location", "rdfs:label", "minCount", "1"), ("ont:Location", "schema:containedInPlace", "nodeKind", "iri"), ("ont:Location", "prop:realm", "nodeKind", "iri"),
    ("ont:Artifact", "rdfs:label", "minCount", "1"), ("ont:Artifact", "prop:objectType", "maxCount", "1"), ("ont:Artifact", "schema:creator", "nodeKind", "iri"),
    ("schema:Event", "rdfs:label", "minCount", "1"), ("schema:Event", "schema:startDate", "maxCount", "1"), ("schema:Event", "schema:location", "nodeKind", "iri"),
    ("ont:Card", "rdfs:label", "minCount", "1"), ("ont:Card", "prop:prowess", "datatype", "xsd:integer"), ("ont:Card", "prop:prowess", "maxCount", "1"),
    ("ont:Card", "prop:body", "datatype", "xsd:integer"), ("ont:Card", "prop:body", "maxCount", "1"),
    ("ont:Character", "schema:name", "datatype", "rdf:langString"),
)
BASIC = tuple((cls, "rdfs:label", "minCount", "1") for cls in ("ont:Character", "ont:Location", "ont:Artifact", "schema:Event"))


def expand(name: str, ns: Namespaces = NS) -> str:
    """The IRI of a prefixed name."""
    from kgspark import model

    prefix, _, rest = name.partition(":")
    return {"ont": ns.ont, "prop": ns.prop, "schema": SCHEMA, "rdfs": model.RDFS, "rdf": model.RDF, "xsd": model.XSD}[prefix] + rest


def ontology_triples(spark: SparkSession, ns: Namespaces = NS) -> DataFrame:
    rows: list[tuple] = []
    for name, parent, label, comment in CLASSES:
        cls = ns.ont + name
        rows += [(cls, TYPE, OWL + "Class", "iri"), (cls, LABEL, label, "literal", None, "en")]
        rows += [(cls, SUBCLASS, SCHEMA + parent, "iri")] if parent else []
        rows += [(cls, COMMENT, comment, "literal", None, "en")] if comment else []
    kinds = {"domain": DOMAIN, "range": RANGE, "super": SUBPROPERTY}
    for name, kind, label, more in PROPERTIES:
        p = expand(name, ns)
        rows += [(p, TYPE, f"{OWL}{kind}Property", "iri"), (p, LABEL, label, "literal", None, "en")]
        rows += [(p, COMMENT, v, "literal", None, "en") if k == "comment" else (p, kinds[k], expand(v, ns), "iri") for k, v in more]
    return triples_of(spark, rows)


def shape_table(spark: SparkSession, extended: bool = True, ns: Namespaces = NS) -> DataFrame:
    """(target_class, path, constraint, value) of the shapes."""
    value = lambda c, v: expand(v, ns) if c == "datatype" else v
    rows = [(expand(t, ns), expand(p, ns), c, value(c, v)) for t, p, c, v in (EXTENDED if extended else BASIC)]
    return spark.createDataFrame(rows, "target_class string, path string, constraint string, value string")


def with_instances(classes: DataFrame, cls: str, graph: DataFrame) -> DataFrame:
    """Rows of a small table with the number ``n`` of instances of the class in a column, 0 where there are none.

    Instances are counted before they meet the table, so no task holds all rows of a class.
    """
    own = edges(graph, TYPE, o=cls).join(classes.select(cls).distinct(), cls, "left_semi")
    return classes.join(own.groupBy(cls).agg(F.count_distinct("s").alias("n")), cls, "left").fillna(0, ["n"])


def shape_triples(spark: SparkSession, ns: Namespaces = NS) -> DataFrame:
    """The basic shapes as triples."""
    rows: list[tuple] = []
    for target, path, _, least in BASIC:
        name = target.partition(":")[2]
        shape = f"{ns.ont}{name}Shape"
        part = shape + "_label"
        rows += [
            (shape, TYPE, SH + "NodeShape", "iri"), (shape, SH + "targetClass", expand(target, ns), "iri"), (shape, LABEL, f"Shape for {name}s", "literal"),
            (shape, SH + "property", part, "iri"), (part, SH + "path", expand(path, ns), "iri"), (part, SH + "minCount", least, "literal", INTEGER),
        ]
    return triples_of(spark, rows)


