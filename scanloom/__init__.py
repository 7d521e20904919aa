"""scanloom: recognised-document text analytics expressed as Spark DataFrame operators.

Every operator is a function from DataFrame(s) and parameters to a DataFrame;
nothing is executed until the caller asks for rows, except where a docstring
says that a bounded statistic is gathered on the driver.
"""

__version__ = "0.1.0"
