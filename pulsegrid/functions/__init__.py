"""pulsegrid.functions"""
