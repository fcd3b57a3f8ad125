"""sparkloom: context-history analytics and training-data operators on Spark DataFrames."""
