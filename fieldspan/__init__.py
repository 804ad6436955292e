"""Topic delimitation over linked document corpora, expressed as Spark jobs.

Operators take DataFrames and return a DataFrame. Nothing that grows with the
data reaches the driver; stages used more than once are written to the shared folder.
"""

__version__ = "0.1.0"
