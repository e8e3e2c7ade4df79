"""Where the tests' tables lie."""
SF001 = "/root/testdata/sf0.001"
