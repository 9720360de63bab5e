"""draftkit: Spark-native data work for training and evaluating draft models.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark
SQL expressions, joins, windows and aggregations.  Subpackages:

* ``sources``   -- readers and writers (chat JSON, prepared samples, feature
                    listings, benchmark JSON/CSV, counter text)
* ``operators`` -- normalisation, rendering/tokenising, sampling and resume,
                    draft vocabulary, sequence shaping, packing, metrics,
                    serving-evaluation analytics
* ``functions`` -- column-expression helpers (keyed draws, array shaping,
                    distributed dense index, salted running sums)
* ``plans``     -- end-to-end plans composed from operators
* ``streaming`` -- Structured Streaming versions of the incremental operators
"""

from draftkit.session import checkpoint_dir, get_session, ship_package

__all__ = ["get_session", "checkpoint_dir", "ship_package"]
