"""changeloom: change streams and tables on PySpark DataFrames.

Every public function takes and returns DataFrames or Columns; Catalyst plans
the joins, shuffles and scans.  ``README.md`` lists the modules, and the id in
a docstring (``CDC-02``) names the row of the coverage list it implements.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
