"""A hand-made graph of 44 triples, the benchmark queries (fixed texts) and their golden counts."""

PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "swrc": "http://swrc.ontoware.org/ontology#",
    "bench": "http://localhost/vocabulary/bench/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

NTRIPLES = r"""
<http://localhost/vocabulary/bench/Article> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://xmlns.com/foaf/0.1/Document> .
<http://localhost/vocabulary/bench/Inproceedings> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://xmlns.com/foaf/0.1/Document> .
<http://localhost/vocabulary/bench/Journal> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://xmlns.com/foaf/0.1/Document> .
<http://localhost/j/J1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://localhost/vocabulary/bench/Journal> .
<http://localhost/j/J1> <http://purl.org/dc/elements/1.1/title> "Journal 1 (1940)"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/j/J1> <http://purl.org/dc/terms/issued> "1940"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/j/J1> <http://swrc.ontoware.org/ontology#number> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/j/J1> <http://swrc.ontoware.org/ontology#volume> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/a/A1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://localhost/vocabulary/bench/Article> .
<http://localhost/a/A1> <http://purl.org/dc/elements/1.1/creator> <http://localhost/p/Erdoes> .
<http://localhost/a/A1> <http://purl.org/dc/elements/1.1/creator> <http://localhost/p/Alice> .
<http://localhost/a/A1> <http://purl.org/dc/elements/1.1/title> "On a | pipe"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/a/A1> <http://swrc.ontoware.org/ontology#journal> <http://localhost/j/J1> .
<http://localhost/a/A1> <http://swrc.ontoware.org/ontology#pages> "12"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/a/A1> <http://purl.org/dc/terms/issued> "1940"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/a/A1> <http://purl.org/dc/terms/references> _:bag1 .
<http://localhost/a/A2> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://localhost/vocabulary/bench/Article> .
<http://localhost/a/A2> <http://purl.org/dc/elements/1.1/creator> <http://localhost/p/Alice> .
<http://localhost/a/A2> <http://purl.org/dc/elements/1.1/title> "Second"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/a/A2> <http://swrc.ontoware.org/ontology#journal> <http://localhost/j/J1> .
<http://localhost/a/A2> <http://purl.org/dc/terms/issued> "1941"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/a/A2> <http://purl.org/dc/terms/references> _:bag2 .
<http://localhost/a/A2> <http://www.w3.org/2000/01/rdf-schema#seeAlso> "http://ee/A2"^^<http://www.w3.org/2001/XMLSchema#string> .
_:bag1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag> .
_:bag1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#_1> <http://localhost/a/A2> .
_:bag2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag> .
_:bag2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#_1> <http://localhost/c/I1> .
_:bag2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#_2> <http://localhost/a/A1> .
<http://localhost/c/I1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://localhost/vocabulary/bench/Inproceedings> .
<http://localhost/c/I1> <http://purl.org/dc/elements/1.1/creator> <http://localhost/p/Bob> .
<http://localhost/c/I1> <http://purl.org/dc/elements/1.1/creator> <http://localhost/p/Alice> .
<http://localhost/c/I1> <http://localhost/vocabulary/bench/booktitle> "Conf"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/c/I1> <http://purl.org/dc/elements/1.1/title> "Third"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/c/I1> <http://purl.org/dc/terms/partOf> <http://localhost/c/P1> .
<http://localhost/c/I1> <http://www.w3.org/2000/01/rdf-schema#seeAlso> "http://ee/I1"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/c/I1> <http://swrc.ontoware.org/ontology#pages> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/c/I1> <http://xmlns.com/foaf/0.1/homepage> "http://hp/I1"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/c/I1> <http://purl.org/dc/terms/issued> "1941"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://localhost/p/Erdoes> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://xmlns.com/foaf/0.1/Person> .
<http://localhost/p/Erdoes> <http://xmlns.com/foaf/0.1/name> "Paul Erdoes"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/p/Alice> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://xmlns.com/foaf/0.1/Person> .
<http://localhost/p/Alice> <http://xmlns.com/foaf/0.1/name> "Alice"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://localhost/p/Bob> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://xmlns.com/foaf/0.1/Person> .
<http://localhost/p/Bob> <http://xmlns.com/foaf/0.1/name> "Bob"^^<http://www.w3.org/2001/XMLSchema#string> .
"""

#: name: (query, bindings, distinct rows)
QUERIES = {
    "q1": (
        """SELECT ?journal ?property ?value WHERE { ?journal rdf:type bench:Journal . ?journal dc:title "Journal 1 (1940)"^^xsd:string . ?journal dcterms:issued ?yr . ?journal swrc:number "1"^^xsd:integer . ?journal swrc:volume "1"^^xsd:integer . ?journal ?property ?value . }""",
        5,
        5,
    ),
    "q2": (
        """SELECT ?inproc ?property ?value WHERE { ?inproc rdf:type bench:Inproceedings . ?inproc dc:creator ?author . ?inproc bench:booktitle ?booktitle . ?inproc dc:title ?title . ?inproc dcterms:partOf ?proc . ?inproc rdfs:seeAlso ?ee . ?inproc swrc:pages ?page . ?inproc foaf:homepage ?url . ?inproc dcterms:issued ?yr . ?inproc ?property ?value . }""",
        20,
        10,
    ),
    "q3": (
        """SELECT ?article ?property ?value WHERE { ?article rdf:type bench:Article . ?article swrc:pages ?pages . ?article ?property ?value . }""",
        8,
        8,
    ),
    "q4": (
        """SELECT ?name1 ?name2 WHERE { ?article1 rdf:type bench:Article . ?article2 rdf:type bench:Article . ?article1 dc:creator ?author1 . ?author1 foaf:name ?name1 . ?article2 dc:creator ?author2 . ?author2 foaf:name ?name2 . ?article1 swrc:journal ?journal1 . ?article2 swrc:journal ?journal2 . }""",
        9,
        4,
    ),
    "q4a": (
        """SELECT ?name1 ?name2 WHERE { ?article1 rdf:type bench:Article . ?article2 rdf:type bench:Article . ?article1 dc:creator ?author1 . ?author1 foaf:name ?name1 . ?article2 dc:creator ?author2 . ?author2 foaf:name ?name2 . ?article1 swrc:journal ?journal . ?article2 swrc:journal ?journal . }""",
        9,
        4,
    ),
    "q5": (
        """SELECT ?person ?property ?value WHERE { ?article rdf:type bench:Article . ?article dc:creator ?person1 . ?inproc rdf:type bench:Inproceedings . ?inproc dc:creator ?person2 . ?person1 foaf:name ?name1 . ?person2 foaf:name ?name2 . ?person ?property ?value . }""",
        264,
        44,
    ),
    "q5a": (
        """SELECT ?person ?property ?value WHERE { ?article rdf:type bench:Article . ?article dc:creator ?person . ?inproc rdf:type bench:Inproceedings . ?inproc dc:creator ?person2 . ?person foaf:name ?name . ?person2 foaf:name ?name . ?person ?property ?value . }""",
        4,
        2,
    ),
    "q6": (
        """SELECT ?yr ?name ?document WHERE { ?class rdfs:subClassOf foaf:Document . ?document rdf:type ?class . ?document dcterms:issued ?yr . ?document dc:creator ?author . ?author foaf:name ?name . }""",
        5,
        5,
    ),
    "q6a": (
        """SELECT ?subject ?property ?object WHERE { ?class rdfs:subClassOf foaf:Document . ?document rdf:type ?class . ?document dcterms:issued ?yr . ?document dc:creator ?author1 . ?author1 foaf:name ?name1 . ?class2 rdfs:subClassOf foaf:Document . ?document2 rdf:type ?class2 . ?document2 dcterms:issued ?yr2 . ?document2 dc:creator ?author1 . }""",
        11,
        1,
    ),
    "q7": (
        """SELECT ?subject ?predicate ?object WHERE { ?class rdfs:subClassOf foaf:Document . ?doc rdf:type ?class . ?doc dc:title ?title . ?bag2 ?member2 ?doc . ?doc2 dcterms:references ?bag2 . ?subject ?predicate ?object . }""",
        132,
        44,
    ),
    "q7a": (
        """SELECT ?subject ?predicate ?object WHERE { ?class rdfs:subClassOf foaf:Document . ?doc rdf:type ?class . ?doc dc:title ?title . ?bag2 ?member2 ?doc . ?doc2 dcterms:references ?bag2 . ?class3 rdfs:subClassOf foaf:Document . ?doc3 rdf:type ?class3 . ?doc3 dcterms:references ?bag3 . ?bag3 ?member3 ?doc . ?class4 rdfs:subClassOf foaf:Document . ?doc4 rdf:type ?class4 . ?doc4 dcterms:references ?bag4 . ?bag4 ?member4 ?doc3 . ?bag4 ?property ?object . ?subject ?predicate ?object . }""",
        10,
        5,
    ),
    "q8": (
        """SELECT ?name WHERE { ?erdoes rdf:type foaf:Person . ?erdoes foaf:name "Paul Erdoes"^^xsd:string . ?document dc:creator ?erdoes . ?document dc:creator ?author . ?document2 dc:creator ?author . ?document2 dc:creator ?author2 . ?author2 foaf:name ?name . }""",
        7,
        3,
    ),
    "q11": (
        """SELECT ?publication ?predicate ?value WHERE { ?publication rdfs:seeAlso ?ee . ?publication ?predicate ?value . }""",
        17,
        17,
    ),
}

PROLOGUE = "".join(f"PREFIX {k}: <{v}> " for k, v in PREFIXES.items())
