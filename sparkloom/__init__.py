"""sparkloom: an analytics engine that plans and runs everything on Spark SQL."""
