"""quireflow: document-structure analytics on Spark tables of page primitives."""
