"""quillon: a knowledge-base and corpus analytics engine written as Spark DataFrame jobs."""
