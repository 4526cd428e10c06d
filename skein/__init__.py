"""skein: graph analytics and corpus preparation as declarative PySpark."""
