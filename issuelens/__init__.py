"""issuelens: issue retrieval and coding-run analytics as Spark jobs.

Every public operator is ``DataFrame -> DataFrame`` (or a pair of them for
operators with a quarantine side output).  Nothing is collected to the
driver; all work is declared with the DataFrame API and planned by Catalyst.
"""

__version__ = "0.1.0"
