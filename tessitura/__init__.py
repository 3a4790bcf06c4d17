"""Signal analytics over keyed collections, written as Spark DataFrame jobs."""
