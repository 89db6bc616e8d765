"""The relational form of linked data.

A node-property table has a row for each value of each property of each node:

graph      `@default` or the name of a named graph
subject    the node's identifier (`_:` marks blank nodes)
property   an absolute IRI, or `@type`
pos        the value's position among those of its property
kind       `value`, `ref` (value is an identifier) or `list` (items holds it)
value      the lexical form or identifier
datatype   of a value; null for references and lists
language   of a value
items      of a list: (kind, value, datatype, language), null otherwise

A quad table has graph (empty for the default graph), subject, predicate, object
kind (`iri`, `blank` or `literal`), object, datatype and language.
"""

ITEM = "struct<kind:string,value:string,datatype:string,language:string>"
NODES = f"graph string, subject string, property string, pos int, kind string, value string, datatype string, language string, items array<{ITEM}>"
NODE_COLUMNS = [c.split()[0] for c in "graph subject property pos kind value datatype language items".split()]
QUADS = "graph string, subject string, predicate string, kind string, object string, datatype string, language string"
QUAD_COLUMNS = "graph subject predicate kind object datatype language".split()
DEFAULT = "@default"
