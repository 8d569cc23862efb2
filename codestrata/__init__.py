"""codestrata: code-history analytics as Spark DataFrame jobs.

A repository's structure (modules, classes, functions, import and call edges) and its evolution
(commits, touched files, snapshots) are plain relations. The subpackages add the operators on top:

* ``functions``  column expressions: path predicates, wildcard patterns, tokens, masking, routing
* ``operators``  DataFrame -> DataFrame: layers, rules, intervals, history, graph reads, decisions, review
* ``sources``    readers that turn log text, diff text, manifests and rule documents into rows
* ``plans``      the registered queries over the driver's tables, with their SQL twins
* ``streaming``  the micro-batch review
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
