"""evalspark: evaluation of model outputs as Spark DataFrame jobs.

Benchmark tables and prediction tables go in, row scores and long-form reports come out.  Every public
function is either ``Column -> Column`` or ``DataFrame -> DataFrame``; nothing collects to the driver.
"""

__version__ = "0.1.0"
