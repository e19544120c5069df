"""pulsegrid.sources"""
